"""A corpus on disk: JSON lines with a header record and exact round trip, folders of plain texts, and places named by the environment."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1


def write(documents: DataFrame, path: str, name: str, note: str = "") -> None:
    """Gzipped JSON lines, and beside them one header record: name, schema, number of documents and their digest."""
    documents.write.option("compression", "gzip").option("ignoreNullFields", "false").json(f"{path}/documents")
    spark = documents.sparkSession
    back = spark.read.schema(documents.schema).json(f"{path}/documents")
    head = {"format": FORMAT, "name": name, "note": note, "schema": documents.schema.json(), **_state(back)}
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(f"{path}/header")


def _state(documents: DataFrame) -> dict:
    columns = [F.to_json(F.struct(*(F.col(f"`{c}`") for c in documents.columns)), {"ignoreNullFields": "false"})]
    n, mark = documents.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64(*columns)), F.lit(0))).first()
    return {"documents": n, "mark": mark}


def header(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/header").first()[0])


def read(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """The documents under their schema; an error where the format is another or rows are missing or changed."""
    from pyspark.sql.types import StructType

    head = header(spark, path)
    if head["format"] != FORMAT:
        raise ValueError(f"format {head['format']}, not {FORMAT}")
    out = spark.read.schema(StructType.fromJson(json.loads(head["schema"]))).json(f"{path}/documents")
    if check and _state(out) != {k: head[k] for k in ("documents", "mark")}:
        raise ValueError(f"{path} doesn't hold what its header says")
    return out


def folder(name: str, restricted: bool = False) -> str:
    """The folder that the environment variable ``MASKWRIGHT_<NAME>`` gives; a restricted one is never guessed, others lie below the working folder."""
    given = os.environ.get(f"MASKWRIGHT_{name.upper()}")
    if given:
        return given
    if restricted:
        raise LookupError(f"set MASKWRIGHT_{name.upper()}: restricted data is not guessed at")
    return os.path.join(os.environ.get("MASKWRIGHT_WORK", os.getcwd()), name)


def topics(spark: SparkSession, path: str, least: int = 50, most: int = 20_000, per_label: int | None = None, seed: int = 0) -> DataFrame:
    """``doc_id, label, text`` of a tree ``label/file``: texts of eligible length, of each label the same number by digest; pointers to large files instead of texts are an error."""
    rows = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path)
    rows = rows.selectExpr("_metadata.file_path as doc_id", "element_at(split(_metadata.file_path, '/'), -2) as label", "value as text")
    stub = "startswith(text, 'version https://git-lfs')"
    rows = rows.selectExpr("doc_id", "label", f"if({stub}, raise_error(concat(doc_id, ' is a pointer, not a text')), text) as text").where(f"length(trim(text)) between {least} and {most}")
    if per_label is None:
        return rows
    picked = rows.selectExpr("*", f"row_number() over (partition by label order by sha2(concat('{seed}|', doc_id), 256), doc_id) as r_")
    return picked.where(f"r_ <= {per_label}").drop("r_")


def labels(rows: DataFrame) -> list[str]:
    return [r[0] for r in rows.select("label").distinct().orderBy("label").collect()]


def formality(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, score`` of a headed list; empty where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "doc_id string, score double")
    return spark.read.csv(path, header=True).selectExpr("cast(doc_id as string) as doc_id", "try_cast(score as double) as score").where("score is not null")
