"""Name lists: census and register files, places, nested JSON, character products and cleaned parts, as inventories and as an attacker's priors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def titled(c: str) -> str:
    """SQL: every run of letters with a capital first, also after an apostrophe or hyphen."""
    return f"array_join(transform(regexp_extract_all({c}, '([\\\\p{{L}}]+|[^\\\\p{{L}}]+)', 1), x -> concat(upper(substring(x, 1, 1)), lower(substring(x, 2)))), '')"


def census(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``name, freq`` of ranked surnames (``name, rank, count``), the first by rank; sums and unreadable rows left out."""
    rows = spark.read.csv(path, header=True).selectExpr(f"{titled('trim(name)')} as name", "try_cast(`rank` as int) as r", "try_cast(`count` as bigint) as freq").where("name <> '' and name <> 'All Other Names' and r > 0 and freq is not null")
    return (rows.orderBy("r", "name").limit(limit) if limit else rows).select("name", "freq")


def given_names(spark: SparkSession, path: str, least: int = 1, limit: int | None = None) -> DataFrame:
    """``name, gender, freq`` of ``Name, Gender, Count``, by count; names with other characters than letters left out."""
    rows = spark.read.csv(path, header=True).selectExpr(f"{titled('trim(Name)')} as name", "lower(Gender) as gender", "try_cast(Count as bigint) as freq").where(f"freq >= {least}" + r" and name rlike '^[\\p{L}\\x27-]+$'")
    return rows.orderBy(F.desc("freq"), "name", "gender").limit(limit) if limit else rows


def cities(spark: SparkSession, path: str, least: int = 0, countries: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """``name, freq`` of populated places (tab separated: name second, class seventh, country ninth, people fifteenth), largest first."""
    rows = spark.read.csv(path, sep="\t", quote="").selectExpr("_c1 as name", "_c6 as class", "_c8 as country", "try_cast(_c14 as bigint) as freq").where(f"class = 'P' and freq >= {least}")
    if countries is not None:
        rows = rows.where(F.col("country").isin(countries))
    one = rows.groupBy("name").agg(F.max("freq").alias("freq"))
    return one.orderBy(F.desc("freq"), "name").limit(limit) if limit else one


def as_inventory(names: DataFrame, type_: str, lang: str, gender: str | None = None) -> DataFrame:
    kind = f"'{gender}'" if gender else ("gender" if "gender" in names.columns else "cast(null as string)")
    return names.selectExpr(f"'{type_}' as type", f"'{lang}' as lang", "name as surface", "cast(freq as double) as freq", f"{kind} as gender")


def as_prior(*lists: DataFrame) -> DataFrame:
    """``name, weight`` over several lists: a name's counts are summed and normalised, names folded."""
    out = None
    for x in lists:
        rows = x.selectExpr("lower(name) as name", "cast(freq as double) as n")
        out = rows if out is None else out.unionByName(rows)
    rows = out.groupBy("name").agg(F.sum("n").alias("n"))
    return rows.join(F.broadcast(rows.agg(F.sum("n").alias("t_")))).selectExpr("name", "n / t_ as weight")


def describe(prior: DataFrame) -> DataFrame:
    """``names, heaviest, entropy`` of a prior."""
    return prior.agg(F.count(F.lit(1)).alias("names"), F.max("weight").alias("heaviest"), F.sum(F.expr("-weight * log2(weight)")).alias("entropy"))


def nested(spark: SparkSession, path: str, fields: dict[str, tuple[str, str | None]], lang: str) -> DataFrame:
    """An inventory from one JSON object of lists, or of objects of lists: ``fields`` names type and gender of each top-level field; every entry weighs one."""
    raw = spark.read.text(path, wholetext=True)
    out = None
    for field, (type_, gender) in fields.items():
        flat = f"coalesce(from_json(get_json_object(value, '$.{field}'), 'array<string>'), flatten(map_values(from_json(get_json_object(value, '$.{field}'), 'map<string, array<string>>'))))"
        rows = raw.selectExpr(f"explode(array_distinct({flat})) as name").selectExpr("name", "1 as freq").where("name <> ''")
        rows = as_inventory(rows, type_, lang, gender)
        out = rows if out is None else out.unionByName(rows)
    return out


def clean_part(c: str) -> str:
    """SQL: an Arabic name part without diacritics and stretching, null where other letters or digits are left."""
    bare = f"trim(regexp_replace({c}, '[\\u064b-\\u065f\\u0670\\u0640]', ''))"
    return f"if({bare} rlike '^[\\u0621-\\u064a]{{2,}}( [\\u0621-\\u064a]{{2,}})*$', {bare}, null)"


def has_diacritics(c: str) -> str:
    return f"{c} rlike '[\\u064b-\\u065f\\u0670]'"


def number(c: str) -> str:
    """SQL: a count written with separators or Arabic digits."""
    return f"try_cast(regexp_replace(translate({c}, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '[ ,.٬]', '') as bigint)"


def name_parts(mentions: DataFrame) -> DataFrame:
    """``lang, first, last, freq_first, freq_last``: first and last words of attested names of two words, cleaned, with their counts (rows of one side have the other null)."""
    rows = mentions.selectExpr("lang", f"split({clean_part('surface')}, ' ') as p").where("size(p) = 2")
    a = rows.groupBy("lang", F.expr("concat(p[0], ' ')").alias("first")).agg(F.count(F.lit(1)).alias("freq_first"))
    b = rows.groupBy("lang", F.expr("p[1]").alias("last")).agg(F.count(F.lit(1)).alias("freq_last"))
    return a.selectExpr("lang", "first", "cast(null as string) as last", "freq_first", "cast(null as bigint) as freq_last").unionByName(b.selectExpr("lang", "cast(null as string) as first", "last", "cast(null as bigint) as freq_first", "freq_last"))
