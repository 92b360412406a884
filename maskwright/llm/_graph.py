"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two joins over the current edge list;
nothing is gathered on the driver except two counters a round.  Hub vertices
only meet an aggregated one-row-per-vertex side, so a skewed join can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of one comparable type -> ``(node, root)``, root being the smallest node reachable.

    Nodes without an edge to another node do not appear.  Loops, repeated edges
    and null ends are ignored; an empty table gives an empty table.
    """
    scratch = Scratch(spark)
    now = scratch.keep(edges.where("a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct(), "edges")
    seen = None
    while True:  # until a round changes nothing
        mark = now.selectExpr("count(1)", "bit_xor(xxhash64(u, v))", "sum(cast(xxhash64(v, u) as decimal(38, 0)))").first()
        if not mark[0] or mark == seen:
            break
        seen = mark
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.keep(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch.keep(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        scratch.drop(now, large)
        now = small
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
