"""A streamed placeholder release: stateless, so any batch of documents can be released as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions import keys

_NAMES = r"[A-ZÀ-Þ][a-zß-ÿ]{3,}"


def released(docs: DataFrame) -> DataFrame:
    """``doc_id, released``: name-like words replaced in place, one expression per row."""
    return docs.selectExpr("doc_id", rf"regexp_replace(text, '(?<![\\p{{L}}\\p{{N}}]){_NAMES}(?![\\p{{L}}\\p{{N}}])', {keys.placeholder(chr(39) + 'PERSON' + chr(39))}) as released")


def start(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str) -> StreamingQuery:
    docs = spark.readStream.schema(schema).parquet(source)
    return released(docs).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
