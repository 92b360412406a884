"""Audits of layers, records and releases: precision by rule, skipped spans, compared reference layers, recurring surfaces, correlations, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rule_precision(spans: DataFrame, gold: DataFrame, by: str = "detector") -> DataFrame:
    """``rule, type, spans, exact, overlap``: of each rule's spans how many are a reference mention of their type, exactly or in part."""
    near = spans.alias("s").join(gold.alias("g"), F.expr("s.doc_id = g.doc_id and s.type = g.type and g.end > s.start and g.start < s.end"), "left")
    per = near.groupBy(F.col(f"s.{by}").alias("rule"), "s.type", "s.doc_id", "s.start", "s.end").agg(F.max(F.expr("g.start = s.start and g.end = s.end")).alias("e_"), F.count("g.doc_id").alias("k_"))
    return per.groupBy("rule", "type").agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.coalesce("e_", F.lit(False))).alias("exact"), F.count_if(F.col("k_") > 0).alias("overlap"))


def rule_recall(spans: DataFrame, gold: DataFrame, by: str = "detector") -> DataFrame:
    """``rule, type, found``: reference mentions that a rule's span of their type overlaps (``mentions`` of the type beside)."""
    hit = gold.alias("g").join(spans.alias("s"), F.expr("s.doc_id = g.doc_id and s.type = g.type and g.end > s.start and g.start < s.end"))
    found = hit.select(F.col(f"s.{by}").alias("rule"), "g.type", "g.doc_id", "g.ord").distinct().groupBy("rule", "type").agg(F.count(F.lit(1)).alias("found"))
    return found.join(gold.groupBy("type").agg(F.count(F.lit(1)).alias("mentions")), "type").select("rule", "type", "found", "mentions")


def skip_rate(resolved: DataFrame, corpus: str = "corpus") -> DataFrame:
    """``corpus, written, skipped, rate`` of resolved spans."""
    rows = resolved.groupBy(corpus).agg(F.count_if("kept").alias("written"), F.count_if(~F.col("kept")).alias("skipped"))
    return rows.withColumn("rate", F.col("skipped") / (F.col("written") + F.col("skipped")))


def compare_layers(old: DataFrame, new: DataFrame) -> DataFrame:
    """``change, type, n`` between two reference layers ``doc_id, start, end, type``: dropped, added and kept mentions."""
    a, b = (x.select("doc_id", "start", "end", "type").distinct() for x in (old, new))
    both = a.withColumn("a_", F.lit(1)).join(b.withColumn("b_", F.lit(1)), ["doc_id", "start", "end", "type"], "full")
    return both.selectExpr("type", "case when b_ is null then 'dropped' when a_ is null then 'added' else 'kept' end as change").groupBy("change", "type").agg(F.count(F.lit(1)).alias("n"))


def equal_texts(old: DataFrame, new: DataFrame) -> DataFrame:
    """``same, changed, missing``: documents of ``old`` whose text ``new`` has, has otherwise, or lacks, by digest."""
    a, b = (x.selectExpr("doc_id", f"sha2(text, 256) as {n}") for x, n in ((old, "d_"), (new, "e_")))
    return a.join(b, "doc_id", "left").agg(F.count_if(F.expr("d_ = e_")).alias("same"), F.count_if(F.expr("d_ <> e_")).alias("changed"), F.count_if(F.col("e_").isNull()).alias("missing"))


def length_bands(gold: DataFrame) -> DataFrame:
    """``type, band, n`` of mentions by characters."""
    return gold.selectExpr("type", "case when end - start <= 4 then '1-4' when end - start <= 8 then '5-8' when end - start <= 16 then '9-16' else '17+' end as band").groupBy("type", "band").agg(F.count(F.lit(1)).alias("n"))


def recurring(gold: DataFrame) -> DataFrame:
    """``documents, surfaces``: in how many documents a surface stands."""
    return gold.groupBy("text").agg(F.countDistinct("doc_id").alias("documents")).groupBy("documents").agg(F.count(F.lit(1)).alias("surfaces"))


def record_counts(records: DataFrame, docs: DataFrame) -> DataFrame:
    """``detector, records, failed, truncated, stale, usable`` of the last record of every document."""
    now = docs.selectExpr("doc_id", "substring(sha2(text, 256), 1, 16) as now_")
    last = records.groupBy("doc_id", "detector").agg(F.max_by(F.struct("text_sha256", "error", "truncated"), "seq").alias("r")).select("doc_id", "detector", "r.*").join(now, "doc_id")
    bad = "case when error is not null then 'failed' when truncated then 'truncated' when text_sha256 <> now_ then 'stale' else 'usable' end"
    rows = last.selectExpr("detector", f"{bad} as state")
    return rows.groupBy("detector").agg(F.count(F.lit(1)).alias("records"), *(F.count_if(F.col("state") == s).alias(s) for s in ("failed", "truncated", "stale", "usable")))


def correlation(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """``by, n, pearson`` of two measures of sources."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("pearson"))


def numeric_order(stem: str) -> str:
    """SQL to order names that are numbers by value, others after them by name."""
    return f"struct(try_cast({stem} as bigint) is null, try_cast({stem} as bigint), {stem})"


def german_date(c: str) -> str:
    """SQL: ``D.M.YY``, ``YYYY-MM-DD`` or ``D. Monat YYYY`` as ``DD.MM.YYYY``, null for anything else."""
    months = ", ".join(f"'{m}'" for m in "januar februar märz april mai juni juli august september oktober november dezember".split())
    dmy, ymd, word = r"^([0-9]{1,2})[.]([0-9]{1,2})[.]([0-9]{2,4})$", r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", r"^([0-9]{1,2})[.] *([A-Za-zäÄ]+) +([0-9]{4})$"
    g = lambda p, n: f"regexp_extract({c}, '{p}', {n})"
    year = f"if(length({g(dmy, 3)}) = 2, concat('20', {g(dmy, 3)}), {g(dmy, 3)})"
    month = f"array_position(array({months}), lower({g(word, 2)}))"
    parts = (
        (f"{c} rlike '{dmy}'", g(dmy, 1), g(dmy, 2), year), (f"{c} rlike '{ymd}'", g(ymd, 3), g(ymd, 2), g(ymd, 1)), (f"{c} rlike '{word}' and {month} > 0", g(word, 1), f"cast({month} as string)", g(word, 3)),
    )
    ladder = " ".join(f"when {ok} then concat_ws('.', lpad({d}, 2, '0'), lpad({m}, 2, '0'), {y})" for ok, d, m, y in parts)
    return f"(case {ladder} end)"


# Where the lists of names come from.
PRIORS = (("census", "surnames of a census, ranked with counts"), ("register", "given names with gender and counts"), ("places", "populated places with inhabitants"), ("corpus", "the corpus's own distribution, an upper bound"))


def attack_row(attack: str, condition: str, source: str, result: dict[str, float | None], note: str = "") -> list[tuple]:
    """One result as long rows ``attack, condition, source, measure, value, note``; an abstention or an undefined measure is null."""
    return [(attack, condition, source, k, None if v is None or v != v else float(v), note) for k, v in sorted(result.items())]
