"""A corpus pipeline of five of the operators, each stage written and read again.

Language ID drops documents without a recognisable language; SimHash keeps the
least id of every group of near-duplicates; substring removal takes repeated
windows out of the texts left; mixing takes each source's share of a budget;
packing places what is left in sequences.

All stages: an empty table gives an empty table; null ids are allowed; all but
the last return the columns of ``docs``, whatever further columns there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm._shared import Scratch, free_prefix
from maskwright.llm.langid import accepted
from maskwright.llm.mix import mix_sources
from maskwright.llm.pack import best_fit_pack
from maskwright.llm.simhash import simhash_dedup
from maskwright.llm.substring import substring_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Share of the tokens that mixing takes, each at most once.
MIX_SHARE, MIX_EPOCHS = 0.95, 1

_WORDS = r"split(btrim({}, ' \t\n\u000b\f\r'), '[ \\t-\\r]+')"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, null languages filled in.

    Null and letterless texts go, and texts that score below all but a few of
    the held-out documents; repeated rows are judged alike.
    """
    return accepted(docs)


def _marked(docs: DataFrame, own: str) -> DataFrame:
    return docs.withColumn(own + "mark", F.xxhash64(F.coalesce("text", F.lit(""))))


def _same(docs: DataFrame, own: str, chosen: DataFrame):
    return docs["doc_id"].eqNullSafe(chosen[own + "id"]) & (docs[own + "mark"] == chosen[own + "of"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the least id, of different texts under it the one with the least hash, of rows repeating both any one.

    Texts without words are one group (null and empty text alike).
    """
    scratch, own = Scratch(spark), free_prefix(docs.columns)
    found = scratch.keep(simhash_dedup(spark, docs), "near")
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("group_root")
    first = first.agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count(F.lit(1)).alias("rows"))
    chosen = scratch.keep(first.select(F.col("first.doc_id").alias(own + "id"), F.col("first.mark").alias(own + "of"), "rows"), "chosen")
    marked = _marked(docs, own)
    kept = marked.join(chosen, _same(marked, own, chosen), "left_semi")
    if chosen.where("rows > 1").limit(1).count():  # rows with one id: some may repeat the text too
        kept = kept.dropDuplicates(["doc_id", own + "mark"])
    return kept.drop(own + "mark")


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words of windows that occur earlier; ``n_chars``, where there is one, is counted anew.

    Null text stays null; rows repeating id and text are one document and each
    keeps what is kept.
    """
    out = substring_dedup(spark, docs, with_text=True).select(*(F.col(f"`{c}`") for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of every leaf's budget, once for each epoch that takes them.

    The document at the edge of a leaf's prefix keeps only the words its budget
    still holds, joined by single spaces (``n_chars`` is counted anew).  Rows
    repeating id and text are taken or left together; null text has no words
    and stays if the prefix reaches it.
    """
    own = free_prefix(docs.columns)
    taken = mix_sources(spark, docs, share=MIX_SHARE, epochs=MIX_EPOCHS).groupBy("doc_id", "mark", "epoch").agg(F.max("n_tokens").alias(own + "n"), F.max("take_tokens").alias(own + "take"))
    taken = taken.select(F.col("doc_id").alias(own + "id"), F.col("mark").alias(own + "of"), own + "n", own + "take")
    marked = _marked(docs, own)
    rows = marked.join(taken, _same(marked, own, taken))
    cut = F.col(own + "take") < F.col(own + "n")
    rows = rows.withColumn("text", F.when(cut, F.expr(f"array_join(slice({_WORDS.format('text')}, 1, cast({own}take as int)), ' ')")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 4096 tokens; null text is empty and still ends."""
    return best_fit_pack(spark, docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash_dedup", near_dedup),
    ("substring_dedup", remove_repeats),
    ("mix_sources", mix),
    ("best_fit_pack", pack),
]

#: No stage but the counts can be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
