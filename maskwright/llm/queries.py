"""The queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import digest_chat, format_chat
from .embed import embedding_dedup
from .langid import identify_language
from .lm import lm_score
from .mix import mix_sources
from .pack import best_fit_pack
from .quality import quality_rules
from .simhash import simhash_dedup
from .substring import substring_dedup
from .tokenbin import read_token_files, write_token_files


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(spark, _documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(spark, _documents(spark, sf_dir))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark, _documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark, _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(spark, _documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(spark, _documents(spark, sf_dir))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return digest_chat(format_chat(turns.unionAll(own)))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, _documents(spark, sf_dir)).drop("mark")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(spark, write_token_files(spark, _documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_pack": op1_best_fit_pack,
    "op2_simhash": op2_simhash,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_lm_score": op6_lm_score,
    "op7_language_id": op7_language_id,
    "op8_chat_format": op8_chat_format,
    "op9_mix_sources": op9_mix_sources,
    "op10_token_files": op10_token_files,
}

ORACLES: dict[str, str] = {
    "op8_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
        SELECT conv_id, count(*)::BIGINT AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(15 + length(role) + length(text) + length(role || text) - length(replace(replace(replace(role || text, '\', ''), '<', ''), '>', '')))::BIGINT AS formatted_chars
        FROM turns GROUP BY conv_id""",
}
