"""Building pseudonymised releases: overlap resolution, assignment, splice and offset algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.text import digest16

KEY = b"maskwright-demo-key"
SIV_KEY = bytes(range(32))

def resolve_overlaps(spans: DataFrame) -> DataFrame:
    """``doc_id, ord, start, end, text, type, kept``: left to right with a cursor; longer first at one start; a skipped span doesn't move the cursor."""
    rows = spans.selectExpr("doc_id", "struct(start, start - end as len_, end, text, type) as s").groupBy("doc_id").agg(F.array_sort(F.collect_set("s")).alias("s"))
    fold = f"""aggregate(s, struct(0 as cursor, cast(array() as array<struct<start: int, end: int, text: string, type: string, kept: boolean>>) as done),
        (a, x) -> struct(if(x.start >= a.cursor, x.end, a.cursor) as cursor,
            concat(a.done, array(struct(x.start as start, x.end as end, x.text as text, x.type as type, x.start >= a.cursor as kept))) as done),
        a -> a.done)"""
    return rows.selectExpr("doc_id", f"posexplode({fold}) as (ord, x)").selectExpr("doc_id", "ord", "x.start as start", "x.end as end", "x.text as text", "x.type as type", "x.kept as kept")


def assign(spans: DataFrame, normaliser: str = "N2", policy: str = "deterministic", technique: str = "hmac") -> DataFrame:
    """Adds ``entity_key``, ``scope`` and ``idx``.

    The first span by document and place gives a scope its surface; the index
    is a function of the scope, so only the surface needs a shuffle.
    """
    keys.register(spans.sparkSession)
    norm = keys.NORMALISERS[normaliser]("text")
    rows = spans.selectExpr("*", f"{keys.entity_key('type', norm)} as entity_key")
    rows = rows.selectExpr("*", f"{keys.POLICIES[policy]('entity_key', 'doc_id', 'start')} as scope")
    if technique == "unique":
        return rows.join(drawn(rows.select("scope"), 7), "scope").select(*rows.columns, "idx")
    index = {
        "hmac": lambda: keys.hmac_index("scope", KEY), "hash": lambda: keys.hash_index("scope"), "table": lambda: keys.table_index("scope", 7, 1 << 32), "aes_siv": lambda: keys.siv_index("scope", "type", SIV_KEY)
    }[technique]()
    return rows.selectExpr("*", f"{index} as idx")


def drawn(scopes: DataFrame, seed: int, buckets: int = 4096) -> DataFrame:
    """``scope, idx``: a draw without replacement, a scope's rank by seeded digest.

    Ranks come from counts of digest buckets, so no task orders all scopes.
    """
    one = scopes.distinct().selectExpr("scope", f"sha2(concat_ws('|', '{seed}', scope), 256) as d_").selectExpr("*", f"cast(conv(substring(d_, 1, 8), 16, 10) as bigint) % 4294967296 div {(1 << 32) // buckets} as b_")
    sums = one.groupBy("b_").count().selectExpr("b_", "coalesce(sum(count) over (order by b_ rows between unbounded preceding and 1 preceding), 0) as before_")
    return one.join(F.broadcast(sums), "b_").selectExpr("scope", "before_ + row_number() over (partition by b_ order by d_, scope) - 1 as idx")


def counter(spans: DataFrame) -> DataFrame:
    """``type, scope, ordinal`` by first appearance in (document, place) order within a type.

    The ordinal is global, so entities, not mentions, meet in one sorted
    sequence per type after the aggregation.
    """
    first = spans.groupBy("type", "scope").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    # ranks within a document, then documents before it: no task orders all entities of a type
    within = first.selectExpr("type", "scope", "first.doc_id as d_", "row_number() over (partition by type, first.doc_id order by first.start) as r_")
    docs = within.groupBy("type", "d_").agg(F.count(F.lit(1)).alias("n_"))
    before = ranked_sums(docs, "d_", "n_", "type")
    return within.join(before, ["type", "d_"]).selectExpr("type", "scope", "before_ + r_ - 1 as ordinal")


def ranked_sums(rows: DataFrame, order: str, size: str, *by: str) -> DataFrame:
    """``by, order, before_``: the sum of ``size`` over smaller keys, from range partitions and one sum for each."""
    spread = rows.select(*by, order, size).repartitionByRange(*by, order).selectExpr("*", "spark_partition_id() as p_")
    # partitions are ranges of (by, order), so sums by partition are ordered by their number
    sums = spread.groupBy(*by, "p_").agg(F.sum(size).alias("s_"))
    part = f"partition by {', '.join(by)} " if by else ""
    upto = sums.selectExpr(*by, "p_", f"coalesce(sum(s_) over ({part}order by p_ rows between unbounded preceding and 1 preceding), 0) as u_")
    inner = f"coalesce(sum({size}) over (partition by {', '.join([*by, 'p_'])} order by {order} rows between unbounded preceding and 1 preceding), 0) as w_"
    return spread.selectExpr("*", inner).join(upto, [*by, "p_"]).selectExpr(*by, order, "u_ + w_ as before_")


def surrogate(type_: str = "type", idx: str = "idx", text: str = "text") -> str:
    """Condition B by type: pooled types from the inventory, codes by shape, the rest unchanged."""
    return f"""case when {type_} in ('PERSON', 'LOC', 'ORG', 'DEMOGRAPHIC') then {keys.synthetic(idx, type_)}
        when {type_} = 'CODE' then {keys.format_preserving(text, idx)} else {text} end"""


def differs(surrogate_: str = "surrogate", text: str = "text", type_: str = "type") -> str:
    """Whether a drawn surrogate is another name than its source (types that aren't drawn pass)."""
    return f"(not {type_} in ('PERSON', 'LOC', 'ORG', 'DEMOGRAPHIC') or lower({surrogate_}) <> lower({text}))"


def consistent(surrogate_: str = "surrogate", text: str = "text", type_: str = "type") -> str:
    """Whether a code's surrogate has the source's length, differs if the source has a letter or digit, and is a date or time if the source is one."""
    alike = f"length({surrogate_}) = length({text}) and ({surrogate_} <> {text} or not {text} rlike '[A-Za-z0-9]')"
    return f"({type_} <> 'CODE' or ({alike} and (not {keys.is_date(text)} or {keys.is_date(surrogate_)})))"


def checked_surrogate(spans: DataFrame, predicate: str | None = None, draws: int = 512) -> DataFrame:
    """Adds ``attempt`` and ``surrogate``: the first of ``draws`` deterministic draws that meets ``predicate``; an error if none does.

    Attempt 0 uses the index itself.  Later draws are made inside the row and
    only for rows that fail, up to the first that passes.
    """
    ok = predicate or f"{differs()} and {consistent()}"
    rows = spans.withColumns({"attempt": F.lit(0), "surrogate": F.expr(surrogate())})
    kept = [f"`{c}`" for c in spans.columns]
    for n in range(1, 4):  # nearly all rows that fail pass within these
        again = surrogate(idx=f"({keys.redraw('idx', str(n))})")
        rows = rows.selectExpr(*kept, f"if({ok}, attempt, {n}) as attempt", f"if({ok}, surrogate, {again}) as surrogate")
    held = ok.replace("surrogate", "x.surrogate")
    drawn = f"transform(sequence(4, {draws - 1}), n -> struct(n as attempt, {surrogate(idx='(' + keys.redraw('idx', 'n') + ')')} as surrogate))"
    found = f"get(filter({drawn}, x -> {held}), 0)"
    rows = rows.selectExpr(*kept, f"if({ok}, struct(attempt, surrogate), {found}) as drawn_")
    rows = rows.selectExpr(*kept, f"if(drawn_ is null, raise_error('no surrogate passes in {draws} draws'), drawn_) as drawn_")
    return rows.selectExpr(*kept, "drawn_.attempt as attempt", "drawn_.surrogate as surrogate")


def edits(resolved: DataFrame, replacement: str) -> DataFrame:
    """Kept spans with a replacement -> edits with offsets in the new text, by a running sum of length changes."""
    rows = resolved.selectExpr("*", f"{replacement} as replacement")
    shift = "coalesce(sum(length(replacement) - (end - start)) over (partition by doc_id order by start rows between unbounded preceding and 1 preceding), 0)"
    rows = rows.selectExpr("doc_id", "start as old_start", "end as old_end", f"cast(start + {shift} as int) as new_start", "replacement", "text", "type")
    return rows.selectExpr("doc_id", "old_start", "old_end", "new_start", "new_start + length(replacement) as new_end", "replacement", "text", "type")


def effective(edits_: DataFrame) -> DataFrame:
    """Edits that change the text."""
    return edits_.where("replacement <> text")


def splice(docs: DataFrame, edits_: DataFrame, keep_unpatched: bool = True) -> DataFrame:
    """``doc_id, released``: text between the edits and replacements, joined in order; documents without edits pass or are left out."""
    listed = edits_.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("old_start", "old_end", "replacement"))).alias("e"))
    rows = docs.select("doc_id", "text").join(listed, "doc_id", "left" if keep_unpatched else "inner")
    body = "array_join(transform(e, (x, i) -> concat(substring(text, coalesce(get(e, i - 1).old_end, 0) + 1, x.old_start - coalesce(get(e, i - 1).old_end, 0)), x.replacement)), '')"
    return rows.selectExpr("doc_id", f"if(e is null, text, concat({body}, substring(text, element_at(e, -1).old_end + 1))) as released")


def restore(released: DataFrame, edits_: DataFrame) -> DataFrame:
    """The way back: replaced text into the places of the replacements."""
    back = edits_.selectExpr("doc_id", "new_start as old_start", "new_end as old_end", "text as replacement")
    return splice(released.withColumnRenamed("released", "text"), back).withColumnRenamed("released", "text")


def map_offsets(points: DataFrame, edits_: DataFrame) -> DataFrame:
    """``doc_id, at`` -> ``new_at``: the last edit at or before a point moves it; inside an edit of equal length it moves along, else to its start.

    An as-of join by union and a window over the document: no range join.
    """
    both = points.selectExpr("doc_id", "at as k", "1 as is_point", "cast(null as struct<old_start: int, old_end: int, new_start: int, new_end: int>) as e").unionAll(
        edits_.selectExpr("doc_id", "old_start as k", "0 as is_point", "struct(old_start, old_end, new_start, new_end) as e")
    )
    last = both.selectExpr("doc_id", "k", "is_point", "last(e, true) over (partition by doc_id order by k, is_point rows between unbounded preceding and current row) as e").where("is_point = 1")
    new = "case when e is null then k when k >= e.old_end then k + e.new_end - e.old_end when e.new_end - e.new_start = e.old_end - e.old_start then e.new_start + k - e.old_start else e.new_start end"
    return last.selectExpr("doc_id", "k as at", f"{new} as new_at").distinct()


def stale(docs: DataFrame, records: DataFrame) -> DataFrame:
    """Records ``doc_id, text_sha256`` whose digest isn't the document's; documents unknown here are not stale."""
    now = docs.selectExpr("doc_id", f"{digest16('text')} as now_")
    return records.join(now, "doc_id").where("text_sha256 <> now_").drop("now_")
