"""Sweeps over span sources, cost and operating points."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture: seconds a document.
COST = {"strict": 0.3, "loose": 0.1, "title": 0.2, "mail": 0.05, "digits": 0.04, "pair": 0.6}


def plan(
    detectors: list[str], rules: tuple[str, ...] = ("union", "intersection", "vote2"), largest: int = 3, required: tuple[str, ...] = (), extras: tuple[str, ...] = (), smallest: int = 1
) -> list[tuple[str, str, tuple[str, ...]]]:
    """Every subset of ``smallest`` to ``largest`` detectors that holds the ``required`` ones, by rule, in a stable order, then the ``extras`` by label.

    A single detector has no rule; a vote needs more members than votes (of
    ``vote3`` as many: it is then the intersection, and left out).
    """
    out = []
    for k in range(smallest, largest + 1):
        for members in combinations(sorted(detectors), k):
            if not set(required) <= set(members):
                continue
            for rule in rules if k > 1 else ("single",):
                if not rule.startswith("vote") or k > int(rule[4:]):
                    out.append((f"{rule}:{'+'.join(members)}", rule, members))
    known = {label for label, _, _ in out}
    return out + [parse_label(x) for x in extras if x not in known]


def parse_label(label: str) -> tuple[str, str, tuple[str, ...]]:
    """``rule:a+b`` -> label, rule, members."""
    rule, _, members = label.partition(":")
    if not members or not (rule in ("single", "union", "intersection") or rule.startswith("vote") and rule[4:].isdigit()):
        raise ValueError(f"not a span source: {label!r}")
    return label, rule, tuple(members.split("+"))


def sources(spark: SparkSession, detectors: list[str], **limits) -> DataFrame:
    return spark.createDataFrame([(a, b, list(c)) for a, b, c in plan(detectors, **limits)], "source string, rule string, members array<string>")


def token_sets(marked: DataFrame) -> DataFrame:
    """``detectors, gold, n``: how many tokens each set of detectors covers, by whether a reference mention does.

    ``marked`` has a row for every token (``metrics.marked``).  Sets are few
    (two to the number of detectors), so whatever meets them is small.
    """
    return marked.selectExpr("array_sort(sources) as detectors", "mention is not null as gold").groupBy("detectors", "gold").agg(F.count(F.lit(1)).alias("n"))


def sweep(sets: DataFrame, sources_: DataFrame) -> DataFrame:
    """Sensitivity, specificity and precision of every source at token grain, all sources in one job over the sets."""
    totals = sets.agg(F.sum("n").alias("all_"), F.sum(F.expr("if(gold, n, 0)")).alias("gold_"))  # one row
    met = sets.crossJoin(F.broadcast(sources_)).selectExpr("source", "rule", "n", "gold", "size(array_intersect(detectors, members)) as k", "size(members) as m")
    met = met.where("case rule when 'intersection' then k = m when 'vote2' then k >= 2 when 'vote3' then k >= 3 else k >= 1 end")
    rows = met.groupBy("source").agg(F.sum("n").alias("predicted"), F.sum(F.expr("if(gold, n, 0)")).alias("hit")).join(F.broadcast(totals))
    return rows.selectExpr(
        "source", "predicted", "hit", "hit / greatest(gold_, 1) as sensitivity", "1 - (predicted - hit) / greatest(all_ - gold_, 1) as specificity", "hit / predicted as precision"
    )


def ensemble_cost(sources_: DataFrame) -> DataFrame:
    table = " ".join(f"when '{k}' then {v}D" for k, v in COST.items())
    rows = sources_.selectExpr("source", "explode(members) as m").selectExpr("source", f"case m {table} end as c")
    return rows.groupBy("source").agg(F.max("c").alias("parallel"), F.round(F.sum("c"), 6).alias("serial"))


def pareto(points: DataFrame, cost: str, quality: str) -> DataFrame:
    """Points better than every cheaper one (strictly; of equal cost the best, then first)."""
    ranked = points.selectExpr("*", f"row_number() over (partition by {cost} order by {quality} desc, source) as n_").where("n_ = 1")
    return ranked.selectExpr(*(f"`{c}`" for c in points.columns), f"max({quality}) over (order by {cost} rows between unbounded preceding and 1 preceding) as m_").where(f"m_ is null or {quality} > m_").drop("m_")


def operating_points(points: DataFrame, floor: float = 0.5, band: float = 0.9) -> DataFrame:
    """Best and cheapest-in-band sources by sensitivity, and by specificity above a sensitivity floor."""
    out = None
    for name, q, rows in (("sensitivity", "sensitivity", points), ("specificity", "specificity", points.where(f"sensitivity >= {floor}D"))):
        top = rows.agg(F.max(q).alias("top_"))
        best = rows.orderBy(F.desc(q), "parallel", "source").limit(1).selectExpr(f"'max {name}' as point", "source", "parallel", "sensitivity", "specificity")
        fast = rows.join(F.broadcast(top)).where(f"{q} >= {band}D * top_").orderBy("parallel", F.desc(q), "source").limit(1).selectExpr(f"'fast {name}' as point", "source", "parallel", "sensitivity", "specificity")
        out = best.unionAll(fast) if out is None else out.unionAll(best).unionAll(fast)
    return out
