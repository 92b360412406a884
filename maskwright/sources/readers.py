"""Readers of the corpus formats, to ``documents`` and ``mentions`` frames, and the JSON-lines form of a corpus."""

from __future__ import annotations

import email
import email.policy
import html
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAB = """doc_id string, text string, dataset_type string, quality_checked boolean, meta map<string, string>, annotations map<string, struct<entity_mentions: array<struct<
    entity_mention_id: string, entity_type: string, start_offset: int, end_offset: int, entity_id: string, identifier_type: string, span_text: string>>>>"""


def tab_json(spark: SparkSession, path: str, annotator: str = "first", types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Annotated court cases, an array of records a file; of each the first annotator by name (``quality_checked``: in checked records the second, where there is one), or all."""
    rows = spark.read.schema(_TAB).json(path, multiLine=True)
    names = "array_sort(map_keys(annotations))"
    place = "if(coalesce(quality_checked, false) and size(annotations) > 1, 1, 0)" if annotator == "quality_checked" else "0"
    chosen = f"explode({names})" if annotator == "all" else f"get({names}, {place})"
    found = rows.selectExpr("doc_id", "text", "annotations", f"{chosen} as annotator").selectExpr("doc_id", "text", "annotator", "inline(annotations[annotator].entity_mentions)")
    found = found.selectExpr(
        "doc_id", "annotator", "entity_mention_id as mention_id", "start_offset as start", "end_offset as end", "substring(text, start_offset + 1, end_offset - start_offset) as text",
        "if(entity_type = 'DEM', 'DEMOGRAPHIC', entity_type) as type", "entity_type as type_src", "concat(doc_id, '#', entity_id) as entity", "identifier_type as identifier_class",
    )
    if types is not None:
        found = found.where(F.col("type").isin(types))
    return rows.select("doc_id", "text"), found


_TAG = re.compile(r"<(/?)(ENAMEX|COREF)([^>]*)>", re.I)
_ATTRIBUTE = re.compile(r'(\w+)="([^"]*)"')


def parse_sgml(markup: str) -> dict:
    """Text and spans of inline tags; every fragment is unescaped once; tags may nest."""
    text, size, stack, spans, at = [], 0, [], [], 0
    for m in _TAG.finditer(markup):
        part = html.unescape(markup[at : m.start()])
        text.append(part)
        size += len(part)
        at = m.end()
        if not m[1]:
            stack.append((size, dict(_ATTRIBUTE.findall(m[3]))))
        elif stack:
            start, got = stack.pop()
            spans.append({"start": start, "end": size, "label": got.get("TYPE", ""), "chain": got.get("ID", "")})
    text.append(html.unescape(markup[at:]))
    return {"text": "".join(text), "spans": sorted(spans, key=lambda s: (s["start"], -s["end"]))}


_SPANS = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("label", "string").add("chain", "string"))


@F.pandas_udf(T.StructType().add("text", "string").add("spans", _SPANS))
def sgml(markup: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_sgml(m or "") for m in markup], columns=["text", "spans"])


def inline_sgml(spark: SparkSession, path: str) -> DataFrame:
    """One file a document: ``doc_id, text, spans``."""
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("doc_id"), "value")
    return rows.select("doc_id", sgml("value").alias("x")).select("doc_id", "x.text", "x.spans")


_QUOTE = re.compile(r"^\s*(>|-+ ?original message ?-+|-{5,}.*forwarded by)", re.I)


def parse_mail(raw: bytes) -> dict:
    """Headers that matter and the plain body up to the first quote line."""
    m = email.message_from_bytes(raw, policy=email.policy.compat32)
    part = next((p for p in m.walk() if p.get_content_type() == "text/plain"), m)
    body = part.get_payload(decode=True) or b""
    lines = body.decode(part.get_content_charset() or "utf-8", "replace").splitlines()
    cut = next((i for i, x in enumerate(lines) if _QUOTE.match(x)), len(lines))
    people = re.findall(r"[\w.+'-]+@[\w.-]+\w", " ".join(str(m.get(h, "")) for h in ("From", "To", "Cc", "Bcc")))
    return {"subject": str(m.get("Subject", "")), "date": str(m.get("Date", "")), "body": "\n".join(lines[:cut]).strip(), "participants": sorted({p.casefold() for p in people})}


@F.pandas_udf(T.StructType().add("subject", "string").add("date", "string").add("body", "string").add("participants", T.ArrayType(T.StringType())))
def mail(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_mail(r) for r in raw], columns=["subject", "date", "body", "participants"])


def mail_directory(spark: SparkSession, path: str) -> DataFrame:
    """A tree of messages: ``mailbox`` is the folder above; dates become timestamps where they parse."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = rows.select(F.element_at(F.split("path", "/"), -2).alias("mailbox"), F.col("path").alias("doc_id"), mail("content").alias("m")).select("mailbox", "doc_id", "m.*")
    return rows.withColumn("sent", F.expr("try_to_timestamp(regexp_extract(date, '([0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9:]{8})', 1), 'd MMM yyyy HH:mm:ss')"))


def gazetteer(spark: SparkSession, path: str, name: str, weight: str, least: int = 0, sep: str = ",") -> DataFrame:
    """``name, n`` from a headed list, summed over repeats; unreadable weights are left out."""
    rows = spark.read.csv(path, header=True, sep=sep)
    rows = rows.selectExpr(f"initcap(trim(`{name}`)) as name", f"try_cast(`{weight}` as bigint) as n").where(F.col("n").isNotNull() & (F.col("n") >= least) & (F.col("name") != ""))
    return rows.groupBy("name").agg(F.sum("n").alias("n"))


def write_corpus(documents: DataFrame, path: str) -> None:
    """Gzipped JSON lines; Parquet is the native form."""
    documents.write.option("compression", "gzip").json(path)


def read_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Torn lines are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def append_records(records: DataFrame, path: str) -> None:
    """Detector records, one directory per corpus and detector."""
    records.write.mode("append").partitionBy("corpus", "detector").parquet(path)


def pending(documents: DataFrame, records: DataFrame) -> DataFrame:
    """Documents without a good record of their present text."""
    done = records.where("error is null").select("doc_id", "text_sha256").distinct()
    now = documents.withColumn("text_sha256", F.substring(F.sha2("text", 256), 1, 16))
    return now.join(done, ["doc_id", "text_sha256"], "left_anti")


def latest(records: DataFrame) -> DataFrame:
    """The last record of every document and detector."""
    return records.groupBy("doc_id", "detector").agg(F.max_by(F.struct("text_sha256", "error", "spans"), "seq").alias("r")).select("doc_id", "detector", "r.*")
