"""Span-set algebra: overlap clusters within a document and type, and rules that keep one span of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import met


def cluster_single(spans: DataFrame) -> DataFrame:
    """Adds ``cluster``: transitive overlap (touching spans don't) by a running maximum of ends."""
    w = "partition by doc_id, type order by start, end, detector"
    # dealt by document once: all later windows and groups of a document's spans stay in place
    rows = spans.repartition("doc_id").selectExpr("*", f"max(end) over ({w} rows between unbounded preceding and 1 preceding) as reach_")
    return rows.selectExpr(
        *(f"`{c}`" for c in spans.columns), f"cast(sum(case when reach_ is null or start >= reach_ then 1 else 0 end) over ({w} rows between unbounded preceding and current row) as int) as cluster"
    )


def _iou(a: str, b: str) -> str:
    return f"(greatest(least({a}.end, {b}.end) - greatest({a}.start, {b}.start), 0) / (greatest({a}.end, {b}.end) - least({a}.start, {b}.start)))"


def cluster_iou(spans: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, type, start, end, detector, cluster``: a span joins the current cluster if it overlaps any member enough; folded over sorted structs."""
    rows = spans.selectExpr("doc_id", "type", "struct(start, end, detector) as s").groupBy("doc_id", "type")
    rows = rows.agg(F.array_sort(F.collect_list("s")).alias("s"))
    fold = f"""aggregate(s,
        struct(cast(array() as array<struct<start: int, end: int, detector: string>>) as held, 0 as n, cast(array() as array<struct<start: int, end: int, detector: string, cluster: int>>) as done),
        (a, x) -> if(exists(a.held, h -> {_iou('h', 'x')} >= {threshold}D),
            struct(concat(a.held, array(x)) as held, a.n as n, concat(a.done, array(struct(x.start as start, x.end as end, x.detector as detector, a.n as cluster))) as done),
            struct(array(x) as held, a.n + 1 as n, concat(a.done, array(struct(x.start as start, x.end as end, x.detector as detector, a.n + 1 as cluster))) as done)),
        a -> a.done)"""
    return rows.selectExpr("doc_id", "type", f"explode({fold}) as x").selectExpr("doc_id", "type", "x.start as start", "x.end as end", "x.detector as detector", "x.cluster as cluster")


def combine(spans: DataFrame, docs: DataFrame, rule: str, weights: dict[str, float] | None = None, threshold: float = 1.0) -> DataFrame:
    """One span per kept cluster: ``doc_id, type, start, end, text, votes``.

    union keeps the envelope; intersection the narrowest span where every
    detector present in the document agrees; vote2 and majority the most agreed
    (then longest, then first); widest the longest; weighted sums weights.
    """
    clustered = cluster_single(spans)
    keys = "partition by doc_id, type, cluster"
    rows = clustered.selectExpr(
        "*", "end - start as len_", f"min(start) over ({keys}) as env_start", f"max(end) over ({keys}) as env_end", f"size(collect_set(detector) over ({keys})) as votes"
    )
    if rule in ("intersection", "majority"):
        rows = rows.selectExpr("*", "size(collect_set(detector) over (partition by doc_id)) as present")
    if rule not in ("union", "widest", "intersection"):
        rows = rows.selectExpr("*", "count(1) over (partition by doc_id, type, cluster, start, end) as agreed_")
    if rule == "weighted":
        table = " ".join(f"when '{k}' then {v}D" for k, v in (weights or {}).items()) or "when '' then 1D"
        once = "row_number() over (partition by doc_id, type, cluster, detector order by start, end)"
        rows = rows.selectExpr("*", f"{once} as once_").selectExpr("*", f"sum(case when once_ = 1 then case detector {table} else 1D end else 0D end) over ({keys}) as weight_")
    keep = {"union": "true", "widest": "true", "intersection": "votes >= present", "vote2": "votes >= 2", "majority": "votes >= present div 2 + 1", "weighted": f"weight_ >= {threshold}D"}[rule]
    order = {"union": "start, end", "widest": "len_ desc, start", "intersection": "len_, start"}.get(rule, "agreed_ desc, len_ desc, start")
    rows = rows.where(keep).selectExpr("*", f"row_number() over ({keys} order by {order}, detector) as nth_").where("nth_ = 1")
    if rule != "union":
        return rows.selectExpr("doc_id", "type", "start", "end", "text", "votes")
    rows = rows.selectExpr("doc_id", "type", "env_start as start", "env_end as end", "votes")
    return rows.join(docs.select("doc_id", "text"), "doc_id").selectExpr("doc_id", "type", "start", "end", "substring(text, start + 1, end - start) as text", "votes")


def cascade(spans: DataFrame, order: list[str]) -> DataFrame:
    """Accepts, detector by detector, every span that overlaps no accepted span of its type."""
    rank = " ".join(f"when '{d}' then {i}" for i, d in enumerate(order))
    rows = spans.where("detector in (" + ", ".join(f"'{d}'" for d in order) + ")").selectExpr("doc_id", "type", f"struct(case detector {rank} end as r, start, end, detector) as s")
    rows = rows.groupBy("doc_id", "type").agg(F.array_sort(F.collect_list("s")).alias("s"))
    fold = """aggregate(s, cast(array() as array<struct<r: int, start: int, end: int, detector: string>>),
        (a, x) -> if(exists(a, h -> x.start < h.end and h.start < x.end), a, concat(a, array(x))))"""
    return rows.selectExpr("doc_id", "type", f"explode({fold}) as x").selectExpr("doc_id", "type", "x.start as start", "x.end as end", "x.detector as detector")


def token_vote(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, ord, start, end, type, n, label`` of tokens that over half of the document's detectors cover.

    The type is the one most detectors give (first by name on a tie); the label
    is ``B`` where at least half of those detectors begin a span there, else ``I``.
    """
    present = spans.groupBy("doc_id").agg(F.countDistinct("detector").alias("present"))
    toks = met(docs, spans.selectExpr("doc_id", "start", "end", "type", "detector"))
    first = toks.selectExpr("doc_id", "explode(hits) as h", "ord").groupBy("doc_id", "h.start", "h.end", "h.type", "h.detector").agg(F.min("ord").alias("first"))
    rows = toks.selectExpr("doc_id", "ord", "start", "end", "size(array_distinct(transform(hits, h -> h.detector))) as covered", "explode(hits) as h")
    rows = rows.join(first.selectExpr("doc_id as d2", "start as s2", "end as e2", "type as t2", "detector as x2", "first"), F.expr("doc_id = d2 and h.start = s2 and h.end = e2 and h.type = t2 and h.detector = x2"))
    votes = rows.groupBy("doc_id", "ord", "start", "end", "covered", "h.type").agg(F.countDistinct("h.detector").alias("n"), F.countDistinct(F.expr("if(first = ord, h.detector, null)")).alias("begins"))
    best = votes.groupBy("doc_id", "ord", "start", "end", "covered").agg(F.min(F.struct((-F.col("n")).alias("k"), "type", "begins")).alias("b"))
    best = best.join(present, "doc_id").where("2 * covered > present")
    return best.selectExpr("doc_id", "ord", "start", "end", "b.type as type", "-b.k as n", "concat(if(2 * b.begins >= -b.k, 'B-', 'I-'), b.type) as label")


def bio(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, ord, start, end, label``: each token goes to the first span by start, then longest, that covers it; B at a span's first token."""
    toks = met(docs, spans.selectExpr("doc_id", "start", "start - end as len_", "type", "end")).selectExpr("doc_id", "ord", "start", "end", "hits[0] as h")
    first = "ord = min(ord) over (partition by doc_id, h.start, h.end, h.type)"
    return toks.selectExpr("doc_id", "ord", "start", "end", f"concat(if({first}, 'B-', 'I-'), h.type) as label")


def decode_bio(labelled: DataFrame) -> DataFrame:
    """``doc_id, ord, start, end, label`` (O may be left out) -> spans: a B, a change of type or a gap opens one, and so does a stray I."""
    rows = labelled.where("label <> 'O'").selectExpr("doc_id", "ord", "start", "end", "substring(label, 3) as type", "label like 'B-%' as b_")
    w = "over (partition by doc_id order by ord)"
    rows = rows.selectExpr("*", f"b_ or coalesce(lag(ord) {w} <> ord - 1, true) or lag(type) {w} <> type as new_")
    rows = rows.selectExpr("*", "sum(cast(new_ as int)) over (partition by doc_id order by ord rows between unbounded preceding and current row) as run_")
    return rows.groupBy("doc_id", "run_").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("type").alias("type")).drop("run_")


def voters(chosen: DataFrame, spans: DataFrame) -> DataFrame:
    """``chosen`` with ``voters``: the detectors of its type whose spans overlap each, sorted."""
    pairs = chosen.alias("c").join(spans.alias("s"), F.expr("c.doc_id = s.doc_id and c.type = s.type and s.end > c.start and s.start < c.end"))
    return pairs.groupBy("c.doc_id", "c.type", "c.start", "c.end").agg(F.array_sort(F.collect_set("s.detector")).alias("voters"))


def pool_sizes(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """``pool, documents``: how many documents have spans of so many detectors; more than one row means that a share of votes is not one threshold."""
    sizes = spans.groupBy("doc_id").agg(F.countDistinct("detector").alias("pool"))
    return docs.select("doc_id").join(sizes, "doc_id", "left").na.fill(0, ["pool"]).groupBy("pool").agg(F.count(F.lit(1)).alias("documents"))
