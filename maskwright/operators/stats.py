"""Paired statistics over long score tables ``task, condition, doc_id, score``."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def paired(scores: DataFrame, reference: str = "A") -> DataFrame:
    """Differences of every condition to the reference, over documents that both have."""
    base = scores.where(F.col("condition") == reference).selectExpr("task", "doc_id", "score as ref")
    return scores.where(F.col("condition") != reference).join(base, ["task", "doc_id"]).withColumn("diff", F.col("score") - F.col("ref"))


def describe(scores: DataFrame) -> DataFrame:
    return scores.groupBy("task", "condition").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), F.expr("percentile(score, 0.5)").alias("median"))


def average_ranks(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Adds ``rank``: one-based, ties share their mean (from counts below and equal, so no row-by-row window)."""
    keys = ", ".join(by)
    part = f"partition by {keys} " if by else ""
    counts = rows.groupBy(*by, value).count()
    below = counts.selectExpr(*by, value, f"coalesce(sum(count) over ({part}order by {value} rows between unbounded preceding and 1 preceding), 0) + (count + 1) / 2.0D as rank")
    return rows.join(below, [*by, value])


def spearman(pairs: DataFrame, x: str, y: str, by: str) -> DataFrame:
    ranked = average_ranks(average_ranks(pairs, x, by).withColumnRenamed("rank", "rx"), y, by)
    return ranked.groupBy(by).agg(F.corr("rx", "rank").alias("rho"), F.count(F.lit(1)).alias("n"))


def wilcoxon(differences: DataFrame) -> DataFrame:
    """Signed-rank sums of non-zero differences and the rank-biserial effect; all zero gives effect 0."""
    rows = differences.select("task", "condition", "diff").where("diff <> 0").withColumn("size", F.abs("diff"))
    ranked = average_ranks(rows, "size", "task", "condition")
    sums = ranked.groupBy("task", "condition").agg(
        F.sum(F.when(F.col("diff") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("diff") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"), F.count(F.lit(1)).alias("n")
    )
    every = differences.select("task", "condition").distinct()
    return every.join(sums, ["task", "condition"], "left").selectExpr(
        "task", "condition", "coalesce(n, 0) as n", "coalesce(w_plus, 0D) as w_plus", "coalesce(w_minus, 0D) as w_minus", "coalesce((w_plus - w_minus) / (w_plus + w_minus), 0D) as effect"
    )


@F.pandas_udf(T.DoubleType())
def wilcoxon_p(w_plus: pd.Series, w_minus: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided normal approximation (no tie correction); one without differences."""

    def one(p: float, m: float, k: int) -> float:
        if not k:
            return 1.0
        sd = math.sqrt(k * (k + 1) * (2 * k + 1) / 24)
        return math.erfc(abs(min(p, m) - k * (k + 1) / 4) / sd / math.sqrt(2))

    return pd.Series([one(*x) for x in zip(w_plus, w_minus, n, strict=True)])


def mcnemar(differences: DataFrame) -> DataFrame:
    """Discordant counts of binary scores, ``b`` lost and ``c`` gained, and the corrected chi-square (null under 25, where the test is exact)."""
    rows = differences.groupBy("task", "condition").agg(F.sum(F.expr("cast(ref > score as int)")).alias("b"), F.sum(F.expr("cast(score > ref as int)")).alias("c"))
    return rows.selectExpr("task", "condition", "b", "c", "case when b + c >= 25 then pow(abs(b - c) - 1, 2) / (b + c) end as chi2")


@F.pandas_udf(T.DoubleType())
def mcnemar_p(b: pd.Series, c: pd.Series) -> pd.Series:
    def one(x: int, y: int) -> float:
        n = x + y
        if not n:
            return 1.0
        if n < 25:
            return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(x, y) + 1)) / 2**n)
        return math.erfc(math.sqrt((abs(x - y) - 1) ** 2 / n / 2))

    return pd.Series([one(int(x), int(y)) for x, y in zip(b, c, strict=True)])


def benjamini_hochberg(tests: DataFrame, family: str = "family", p: str = "p") -> DataFrame:
    """Adds ``q``: step-up within a family; NaN and null get null and don't count."""
    ok = tests.where(f"{p} is not null and not isnan({p})")
    w = f"partition by {family}"
    ranked = ok.selectExpr("*", f"row_number() over ({w} order by {p}, test) as r_", f"count(1) over ({w}) as m_")
    q = ranked.selectExpr(*(f"`{c}`" for c in tests.columns), f"least(1D, min({p} * m_ / r_) over ({w} order by r_ desc rows between unbounded preceding and current row)) as q")
    rest = tests.where(f"{p} is null or isnan({p})").withColumn("q", F.lit(None).cast("double"))
    return q.unionByName(rest)


def spread(differences: DataFrame) -> DataFrame:
    """Interquartile range (linear interpolation) and sample deviation of paired differences."""
    return differences.groupBy("task", "condition").agg(
        F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("sd_diff"), F.expr("percentile(diff, 0.75) - percentile(diff, 0.25)").alias("iqr")
    )


def span_f1(gold: DataFrame, predicted: DataFrame, typed: bool = True) -> DataFrame:
    """Exact-match F1 by document; both sides empty is 1 and can't appear here, one side empty is 0."""
    on = ["doc_id", "start", "end"] + (["type"] if typed else [])
    g, p = gold.select(*on).distinct(), predicted.select(*on).distinct()
    both = g.join(p, on).groupBy("doc_id").agg(F.count(F.lit(1)).alias("tp"))
    out = g.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_gold")).join(p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pred")), "doc_id", "full").join(both, "doc_id", "left").na.fill(0)
    return out.selectExpr("doc_id", "n_gold", "n_pred", "tp", "2.0D * tp / (n_gold + n_pred) as f1")
