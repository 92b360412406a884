"""Annotation layers of other formats: token alignment of two layers, chains attached by place, tag runs, and clinical XML."""

from __future__ import annotations

import difflib
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPAN = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("chain", "string"))


def carried(target: str, source: str, spans: list[dict]) -> tuple[list[dict], int]:
    """Spans of ``source`` on ``target``, whose tokens differ here and there: both token rows are aligned, and a span moves only if all of its tokens have a partner; and how many did not."""
    cut = lambda text: [(m[0], m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    a, b = cut(source), cut(target)
    partner: dict[int, int] = {}
    for block in difflib.SequenceMatcher(None, [x[0] for x in a], [x[0] for x in b], autojunk=False).get_matching_blocks():
        partner.update(zip(range(block.a, block.a + block.size), range(block.b, block.b + block.size), strict=True))
    out, lost = [], 0
    for s in spans:
        mine = [i for i, (_, x, y) in enumerate(a) if x < s["end"] and s["start"] < y]
        if mine and all(i in partner for i in mine):
            out.append({"start": b[partner[mine[0]]][1], "end": b[partner[mine[-1]]][2], "chain": s["chain"]})
        else:
            lost += 1
    return out, lost


@F.pandas_udf(T.StructType().add("spans", _SPAN).add("dropped", "integer"))
def carry(target: pd.Series, source: pd.Series, spans: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([carried(t or "", s or "", [] if x is None else [dict(y) for y in x]) for t, s, x in zip(target, source, spans, strict=True)], columns=["spans", "dropped"])


def with_chains(names: DataFrame, chains: DataFrame, corpus: str) -> tuple[DataFrame, DataFrame]:
    """``names(doc_id, lang, start, end, type)`` with ``entity``: the chain at exactly the same place, named by corpus and document, else none; and per language how many have one: ``lang, mentions, chained``."""
    one = chains.groupBy("doc_id", "start", "end").agg(F.min("chain").alias("chain"))
    out = names.join(one, ["doc_id", "start", "end"], "left").withColumn("entity", F.expr(f"if(chain is null, null, concat_ws('#', '{corpus}', doc_id, chain))")).drop("chain")
    return out, out.groupBy("lang").agg(F.count(F.lit(1)).alias("mentions"), F.count("entity").alias("chained"))


TAG = re.compile(r"(?<!\w)([BI])-([A-Z]+)(?!\w)")


def tag_runs(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, type, tokens) of runs of tags written in a text: an I goes on the run before it where only white space or a hyphen stands between."""
    runs: list[tuple[int, int, str, int]] = []
    for m in TAG.finditer(text or ""):
        if runs and m[1] == "I" and runs[-1][2] == m[2] and re.fullmatch(r"\s*-?\s*", text[runs[-1][1] : m.start()]):
            runs[-1] = (runs[-1][0], m.end(), m[2], runs[-1][3] + 1)
        else:
            runs.append((m.start(), m.end(), m[2], 1))
    return runs


def runs_of(docs: DataFrame) -> DataFrame:
    """``doc_id, start, end, type, tokens`` of all tag runs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(d, *r) for d, t in zip(frame["doc_id"], frame["text"], strict=True) for r in tag_runs(t)], columns=["doc_id", "start", "end", "type", "tokens"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start int, end int, type string, tokens int")


def parse_cas(xml: bytes) -> dict:
    """Text and typed annotations of one analysis file, with offsets in code points (the file counts UTF-16 units)."""
    root = ET.fromstring(xml)
    local = lambda tag: tag.rpartition("}")[2]
    text = next((e.get("sofaString") or "" for e in root if local(e.tag) == "Sofa"), "")
    at, units = {0: 0}, 0
    for i, c in enumerate(text):
        units += 2 if ord(c) > 0xFFFF else 1
        at[units] = i + 1
    place = lambda e, name: at.get(int(e.get(name, "0")), len(text))
    kinds = {"Medication": "ClassType", "Sectionsentence": "Sectiontypes", "MedRel": "Dependent"}
    spans = [
        {"layer": local(e.tag), "start": place(e, "begin"), "end": place(e, "end"), "label": e.get(kinds[local(e.tag)], ""), "governor": e.get("Governor"), "in_narrative": e.get("InNarrative") == "true"}
        for e in root if local(e.tag) in kinds
    ]
    return {"text": text, "spans": spans}


_CAS = "doc_id string, text string, used string, spans array<struct<layer: string, start: int, end: int, label: string, governor: string, in_narrative: boolean>>"


def clinical(letters: DataFrame) -> DataFrame:
    """``letters(doc_id, text, archive binary)`` -> ``doc_id, text, used, spans``.

    Offsets hold for the letter where both texts are of one length; else the
    file's own text is used (``used`` says which).  A letter without an archive
    has no spans.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text, raw in zip(frame["doc_id"], frame["text"], frame["archive"], strict=True):
                if raw is None:
                    rows.append((doc_id, text, "letter", []))
                    continue
                with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                    cas = parse_cas(z.read(next(n for n in z.namelist() if n.endswith("cas.xmi"))))
                fits = len(cas["text"]) == len(text or "")
                rows.append((doc_id, text if fits else cas["text"], "letter" if fits else "cas", cas["spans"]))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "used", "spans"])

    return letters.select("doc_id", "text", "archive").mapInPandas(run, _CAS)


def date_marks(docs: DataFrame) -> DataFrame:
    """``doc_id, start, end, text, type`` of ``<[Pseudo] ...>`` marks: the mark as a whole is a date."""
    parts = docs.selectExpr("doc_id", "text", "split(text, '<\\\\[Pseudo\\\\] [^>]*>') as p", "regexp_extract_all(text, '(<\\\\[Pseudo\\\\] [^>]*>)', 1) as m")
    rows = parts.selectExpr("doc_id", "m", "p", "posexplode(m) as (i, mark)")
    before = "aggregate(slice(p, 1, i + 1), 0, (a, x) -> a + length(x)) + aggregate(slice(m, 1, i), 0, (a, x) -> a + length(x))"
    return rows.selectExpr("doc_id", f"{before} as start", f"{before} + length(mark) as end", "mark as text", "'DATETIME' as type")
