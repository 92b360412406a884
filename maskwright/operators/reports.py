"""Reports over results: comparisons with their gates, best sources, bands of recall, safety joins, discrimination, shards."""

from __future__ import annotations

import html as _html
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats

#: Scores at or under this mean are near chance, and pairs under this number of documents say nothing.
NEAR_CHANCE, SHARED = 0.05, 5


def kind_of(scores: DataFrame) -> DataFrame:
    """``task, kind``: binary where all scores are 0 or 1, else real."""
    return scores.groupBy("task").agg(F.expr("if(every(score in (0, 1)), 'binary', 'real')").alias("kind"))


def compare(scores: DataFrame, reference: str = "A") -> DataFrame:
    """Every task and condition against the reference: McNemar for binary scores, Wilcoxon for real ones, with dispersion, and q-values within a task.

    Tasks whose reference mean is near chance, and pairs with few shared
    documents, are listed with ``interpretable = false`` and not tested.
    """
    kinds = kind_of(scores)
    base = scores.where(F.col("condition") == reference).groupBy("task").agg(F.avg("score").alias("base"))
    diffs = stats.paired(scores, reference)
    n = diffs.groupBy("task", "condition").agg(F.count(F.lit(1)).alias("shared"), F.avg("diff").alias("mean_diff"))
    gate = n.join(base, "task").join(kinds, "task").withColumn("interpretable", (F.col("base") > NEAR_CHANCE) & (F.col("shared") >= SHARED))
    rounded = diffs.withColumn("diff", F.round("diff", 9))
    real = stats.wilcoxon(rounded).withColumn("p_real", stats.wilcoxon_p("w_plus", "w_minus", "n")).select("task", "condition", "effect", "p_real")
    binary = stats.mcnemar(diffs).withColumn("p_binary", stats.mcnemar_p("b", "c")).select("task", "condition", "b", "c", "p_binary")
    spread = stats.spread(diffs).select("task", "condition", "sd_diff", "iqr")
    rows = gate.join(real, ["task", "condition"]).join(binary, ["task", "condition"]).join(spread, ["task", "condition"])
    rows = rows.withColumn("p", F.expr("if(interpretable, if(kind = 'binary', p_binary, p_real), null)")).withColumn("test", F.col("condition"))
    q = stats.benjamini_hochberg(rows.select("task", "test", "p"), family="task")
    return rows.join(q.select("task", "test", "q"), ["task", "test"]).select("task", "condition", "kind", "shared", "base", "mean_diff", "sd_diff", "iqr", "effect", "interpretable", "p", "q")


def utility_report(compared: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``task, condition, verdict``: changed, unchanged or not interpretable."""
    return compared.selectExpr("task", "condition", f"case when not interpretable then 'not interpretable' when q < {alpha}D then 'changed' else 'unchanged' end as verdict")


def best_sources(scores: DataFrame) -> DataFrame:
    """``criterion, source``: best sensitivity, specificity, F1 and Youden's J (ties to the first by name); most and least eager sources are the attacker's variants."""
    rows = scores.selectExpr("*", "sensitivity + specificity - 1 as youden", "2 * sensitivity * precision / (sensitivity + precision) as f1")
    out = None
    for name, c in (("sensitivity", "sensitivity"), ("specificity", "specificity"), ("f1", "f1"), ("youden", "youden"), ("eager", "predicted"), ("careful", "-predicted")):
        top = rows.where(f"{c} is not null").orderBy(F.expr(c).desc(), "source").limit(1).selectExpr(f"'{name}' as criterion", "source", f"cast({c} as double) as value")
        out = top if out is None else out.unionAll(top)
    return out


def recall_bands(rows: DataFrame, recall: str = "recall", leak: str = "leak", edges: Sequence[float] = (0.5, 0.7, 0.8, 0.9, 0.95)) -> DataFrame:
    """``band, sources, mean, sd``: leakage of sources by their recall."""
    ladder = " ".join(f"when {recall} < {e}D then '< {e:g}'" for e in edges)
    return rows.selectExpr(f"case {ladder} else '>= {edges[-1]:g}' end as band", f"{leak} as v").groupBy("band").agg(F.count(F.lit(1)).alias("sources"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))


def safety(detection: DataFrame, linkage: DataFrame, utility: DataFrame, floor: int = 20) -> DataFrame:
    """Three results joined by source: ``lift`` of linkage over chance, with ``enough`` queries or not, and the safest source marked.

    ``detection(source, youden)``, ``linkage(source, queries, rank1, gallery)``,
    ``utility(source, mean_diff)``; the safest has the least rank-1 among those
    with enough queries, ties by the better Youden's J.
    """
    rows = detection.join(linkage, "source").join(utility, "source").selectExpr("*", "rank1 * gallery as lift", f"queries >= {floor} as enough")
    best = rows.where("enough").agg(F.min(F.struct("rank1", (-F.col("youden")).alias("j"), "source")).alias("b_"))  # one row
    return rows.join(F.broadcast(best)).selectExpr(*rows.columns, "coalesce(source = b_.source, false) as safest")


def candidate_space(flagged: DataFrame, base: str) -> DataFrame:
    """``flagged(source, doc_id, ord)`` -> per attacker variant its tokens, and those the ``base`` variant doesn't flag."""
    mine = flagged.where(F.col("source") == base).select("doc_id", "ord").withColumn("in_", F.lit(1))
    rows = flagged.join(mine, ["doc_id", "ord"], "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("in_").isNull()).alias("beyond"), F.countDistinct("doc_id").alias("documents"))


def auroc(rows: DataFrame, score: str, truth: str, *by: str) -> DataFrame:
    """Area under the curve by rank sums, ties counting half: ``by, positives, negatives, auroc``."""
    ranked = stats.average_ranks(rows.selectExpr(*by, f"{score} as s_", f"cast({truth} as int) as t_"), "s_", *by)
    per = ranked.groupBy(*by).agg(F.sum("t_").alias("positives"), F.sum(F.expr("1 - t_")).alias("negatives"), F.sum(F.expr("if(t_ = 1, rank, 0)")).alias("r_"))
    return per.selectExpr(*by, "positives", "negatives", "(r_ - positives * (positives + 1) / 2) / nullif(positives * negatives, 0) as auroc")


def pairwise_cosine(vectors: DataFrame) -> DataFrame:
    """``pairs, mean``: mean cosine of all pairs of different entities, from the norm of the sum of unit vectors: no pair is formed.

    ``vectors(entity, cols, ws)`` of unit length: the sum over all ordered pairs
    is the squared norm of the total, less the entities' own ones.
    """
    total = vectors.selectExpr("explode(arrays_zip(cols, ws)) as x").groupBy("x.cols").agg(F.sum("x.ws").alias("w")).agg(F.sum(F.expr("w * w")).alias("t"))
    own = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("aggregate(ws, 0D, (a, x) -> a + x * x)")).alias("o"))
    return own.join(F.broadcast(total)).selectExpr("n * (n - 1) div 2 as pairs", "(t - o) / nullif(n * (n - 1), 0) as mean")


def ablated(spans: DataFrame, gold: DataFrame, type_: str = "PERSON") -> DataFrame:
    """The spans of every source, and for each a twin to which the reference mentions of a type are added: ``source`` ends in ``+gold``."""
    sources = spans.select("source").distinct()  # as many as the plan has
    add = gold.where(F.col("type") == type_).select("doc_id", "start", "end").join(F.broadcast(sources.agg(F.collect_list("source").alias("s_")))).selectExpr("explode(s_) as source", "doc_id", "start", "end")
    twin = spans.selectExpr("concat(source, '+gold') as source", "doc_id", "start", "end").unionByName(add.selectExpr("concat(source, '+gold') as source", "doc_id", "start", "end"))
    return spans.select("source", "doc_id", "start", "end").unionByName(twin.distinct())


def decile_sample(rows: DataFrame, key: str, value: str, per: int, seed: int, anchors: Sequence[str] = ()) -> DataFrame:
    """The same number of rows from every tenth of the values, by digest, and the anchors in any case."""
    ranked = rows.selectExpr("*", f"ntile(10) over (order by {value}, {key}) as decile")  # rows of sources, some thousand
    picked = ranked.selectExpr("*", f"row_number() over (partition by decile order by sha2(concat('{seed}|', {key}), 256), {key}) as r_")
    listed = ", ".join(f"'{a}'" for a in anchors) or "''"
    return picked.where(f"r_ <= {per} or {key} in ({listed})").drop("r_")


def dearest(scores: DataFrame, per: int = 3) -> DataFrame:
    """Sources worth running where it is dear: the best few by each of sensitivity, specificity and precision, once each."""
    out = None
    for c in ("sensitivity", "specificity", "precision"):
        top = scores.where(f"{c} is not null").orderBy(F.desc(c), "source").limit(per).select("source")
        out = top if out is None else out.unionAll(top)
    return out.distinct()


def shards(sources: DataFrame, n: int) -> DataFrame:
    """Adds ``shard``: sources in order, dealt round robin."""
    return sources.selectExpr("*", f"(row_number() over (order by source) - 1) % {n} as shard")  # rows of a plan


def merge_shards(parts: DataFrame, key: str = "source") -> DataFrame:
    """Results of shards as one; rows that repeat must agree, an error otherwise."""
    values = [c for c in parts.columns if c not in (key, "shard")]
    rows = parts.groupBy(key).agg(F.countDistinct(F.struct(*values)).alias("k_"), *(F.first(c).alias(c) for c in values))
    return rows.selectExpr(f"if(k_ > 1, raise_error(concat('shards disagree on ', {key})), {key}) as {key}", *(f"`{c}`" for c in values))


def rank_weights(counts: DataFrame, names: DataFrame) -> DataFrame:
    """``names(rank, name)`` and ``counts(rank, n)`` (a published vector of frequencies) -> ``name, freq``: by rank, later names get the last count."""
    last = counts.agg(F.max("rank").alias("m"), F.min_by("n", F.struct((-F.col("rank")).alias("r"))).alias("tail"))
    return names.join(counts, "rank", "left").join(F.broadcast(last)).selectExpr("name", "coalesce(n, tail) as freq")


def page(title: str, tables: dict[str, tuple[Sequence[str], Sequence[Sequence[object]]]]) -> str:
    """Small result tables (columns, rows) as one HTML page; values are escaped."""
    cell = lambda tag, x: f"<{tag}>{_html.escape('' if x is None else f'{x:.4g}' if isinstance(x, float) else str(x))}</{tag}>"
    body = []
    for name, (columns, rows) in tables.items():
        head = "".join(cell("th", c) for c in columns)
        body.append(f"<h2>{_html.escape(name)}</h2><table><tr>{head}</tr>" + "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in rows) + "</table>")
    return f"<!doctype html><meta charset=utf-8><title>{_html.escape(title)}</title><h1>{_html.escape(title)}</h1>" + "".join(body)
