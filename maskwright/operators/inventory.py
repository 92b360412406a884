"""Name inventories ``type, lang, surface, freq`` (and attributes): pools, weighted and stratum draws, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranked(inventory: DataFrame, by: Sequence[str] = ("type", "lang")) -> DataFrame:
    """``by, surface_, place_, size_, upto_, total_``: each pool in order of frequency and name, with cumulated frequencies."""
    pool = f"partition by {', '.join(by)}"
    rows = inventory.selectExpr(*by, "surface as surface_", "cast(freq as double) as freq_")
    order = f"{pool} order by freq_ desc, surface_"
    rows = rows.selectExpr(*by, "surface_", f"row_number() over ({order}) - 1 as place_", f"count(1) over ({pool}) as size_", f"sum(freq_) over ({order} rows between unbounded preceding and current row) as upto_")
    return rows.selectExpr("*", f"max(if(place_ = size_ - 1, upto_, null)) over ({pool}) as total_")


def _picked(rows: DataFrame, entries: DataFrame, by: Sequence[str], weighted: bool) -> DataFrame:
    """``rows`` with ``size_`` of the pool and ``surface_`` drawn from it, both null without a pool: a join with the entry, never with the pool.

    A pool of n names has n equal buckets of cumulated frequency: an entry is in
    each that its interval meets (two on the mean) and a draw meets the entries
    of its own.
    """
    sizes = entries.where("place_ = 0").select(*by, "size_", "total_")  # a row for each pool
    rows = rows.join(F.broadcast(sizes), list(by), "left")
    if not weighted:
        return rows.selectExpr("*", "idx % size_ as place_").join(entries.select(*by, "place_", "surface_"), [*by, "place_"], "left").drop("place_", "total_")
    bucket = lambda x: f"least(size_ - 1, greatest(0L, coalesce(cast(floor({x} / nullif(total_, 0D) * size_) as bigint), 0L)))"
    held = entries.selectExpr("*", f"coalesce(lag(upto_) over (partition by {', '.join(by)} order by place_), 0D) as from_")
    held = held.selectExpr(
        *by, "surface_", "if(place_ = 0, -double('infinity'), from_) as low_", "if(place_ = size_ - 1, double('infinity'), upto_) as high_",
        f"explode(sequence(if(place_ = 0, 0L, {bucket('from_')}), if(place_ = size_ - 1, size_ - 1, {bucket('upto_')}))) as bucket_",
    )
    rows = rows.selectExpr("*", "idx / 4294967296D * total_ as at_").selectExpr("*", f"{bucket('at_')} as bucket_").alias("m")
    on = " and ".join(f"m.{c} = e.{c}" for c in (*by, "bucket_"))
    return rows.join(held.alias("e"), F.expr(f"{on} and m.at_ >= e.low_ and m.at_ < e.high_"), "left").select("m.*", "e.surface_").drop("at_", "bucket_", "total_")


def drawn(mentions: DataFrame, inventory: DataFrame, weighted: bool = False, attributes: Sequence[str] = ()) -> DataFrame:
    """``mentions(type, lang, idx, ...)`` with ``surrogate``: from the pool of type and language, or the stratum of the attributes where one has names.

    Uniform draws take entry ``idx mod size``; weighted ones the first whose
    cumulated frequency is over ``idx / 2**32`` of the total.  A type and
    language without a pool is an error, never another language.
    """
    by = ["type", "lang"]
    rows = _picked(mentions, ranked(inventory, by), by, weighted)
    if attributes:
        strata = ranked(inventory.where(" and ".join(f"{a} is not null" for a in attributes)), [*by, *attributes])
        rows = _picked(rows.withColumnsRenamed({"size_": "size0_", "surface_": "surface0_"}), strata, [*by, *attributes], weighted)
        rows = rows.withColumns({"surface_": F.expr("if(size_ is null, surface0_, surface_)"), "size_": F.coalesce("size_", "size0_")})
    message = "concat('no names for type ', type, ', language ', coalesce(lang, '(null)'))"
    return rows.selectExpr(*(f"`{c}`" for c in mentions.columns), f"if(size_ is null, raise_error({message}), surface_) as surrogate")


def attested(mentions: DataFrame, least: int = 2, limit: int | None = None) -> DataFrame:
    """``type, lang, surface, freq`` of surfaces seen ``least`` times or more; with ``limit`` only the most frequent of each pool."""
    rows = mentions.groupBy("type", "lang", "surface").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least)
    if limit is None:
        return rows
    return rows.selectExpr("*", "row_number() over (partition by type, lang order by freq desc, surface) as r_").where(f"r_ <= {limit}").drop("r_")


def merged(*inventories: DataFrame) -> DataFrame:
    """Several inventories as one; a pool may come from one of them only."""
    out = None
    for n, x in enumerate(inventories):
        rows = x.select("type", "lang", "surface", "freq", F.lit(n).alias("of_"))
        out = rows if out is None else out.unionByName(rows)
    twice = out.groupBy("type", "lang").agg(F.countDistinct("of_").alias("k")).where("k > 1").select("type", "lang")
    checked = out.join(F.broadcast(twice.withColumn("twice_", F.lit(True))), ["type", "lang"], "left")
    return checked.selectExpr("type", "lang", "surface", "if(twice_, raise_error(concat('two inventories hold ', type, ', ', lang)), freq) as freq")


def uncovered(mentions: DataFrame, inventory: DataFrame) -> DataFrame:
    """``type, lang, n``: pairs of type and language that mentions need and no pool has."""
    need = mentions.groupBy("type", "lang").agg(F.count(F.lit(1)).alias("n"))
    have = inventory.select("type", "lang").distinct()
    return need.join(have, (need["type"] == have["type"]) & need["lang"].eqNullSafe(have["lang"]), "left_anti")


def recombined(parts: DataFrame, attested_: DataFrame, limit: int = 40_000) -> DataFrame:
    """``parts(lang, first, last, freq_first, freq_last)`` as separate rows of first and last names -> full names by weight product, none of them attested, at most ``limit`` a language.

    Pairs are formed between the heads of both lists only: of ``limit`` pairs by
    product none has a member below rank ``limit`` of its list, and at most
    ``limit / r`` partners go with the r-th first name.
    """
    a = parts.where("first is not null").selectExpr("lang", "first", "freq_first", "row_number() over (partition by lang order by freq_first desc, first) as r_").where(f"r_ <= {limit}")
    b = parts.where("last is not null").selectExpr("lang", "last", "freq_last", "row_number() over (partition by lang order by freq_last desc, last) as s_").where(f"s_ <= {limit}")
    pairs = a.join(b, "lang").where(f"r_ * s_ <= {limit}").selectExpr("lang", "concat(first, last) as surface", "cast(freq_first as double) * freq_last as freq")
    pairs = pairs.groupBy("lang", "surface").agg(F.max("freq").alias("freq")).join(attested_.select("lang", "surface"), ["lang", "surface"], "left_anti")
    return pairs.selectExpr("*", "row_number() over (partition by lang order by freq desc, surface) as r_").where(f"r_ <= {limit}").drop("r_")
