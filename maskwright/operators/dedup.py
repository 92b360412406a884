"""Exact duplicates, shingle near-duplicates and thread keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..staging import written
from .construct import ranked_sums

_FOLD = r"trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' '))"


def exact(docs: DataFrame) -> DataFrame:
    """``digest, doc_id, copies``: the least id of every group of equal white-space-folded texts."""
    return docs.selectExpr("doc_id", f"sha1({_FOLD}) as digest").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def members(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, representative``: every document with the least id of its exact copies."""
    rows = docs.selectExpr("doc_id", f"sha1({_FOLD}) as digest")
    return rows.join(rows.groupBy("digest").agg(F.min("doc_id").alias("representative")), "digest").select("doc_id", "digest", "representative")


def shingle_sets(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id, set_``: distinct hashes of lower-cased word runs."""
    rows = docs.selectExpr("doc_id", f"filter(split(lower({_FOLD}), ' '), w -> w <> '') as w")
    runs = f"if(size(w) < {size}, cast(array() as array<bigint>), array_distinct(transform(sequence(0, size(w) - {size}), i -> xxhash64(array_join(slice(w, i + 1, {size}), ' ')))))"
    return rows.selectExpr("doc_id", f"{runs} as set_")


def near_pairs(docs: DataFrame, jaccard: float = 0.8, containment: float = 0.9, least: int = 10, size: int = 5) -> DataFrame:
    """Pairs of distinct texts with Jaccard at least ``jaccard``, or containment at least ``containment`` of a smaller side of ``least`` shingles.

    Exact texts are collapsed first.  Only shingles of at least two texts meet.
    A prefix filter bounds the meeting: of the smaller text's shingles, rarest
    first, a partner must hold one of the first ``n - ceil(t * n) + 1``; common
    ones, which a third of all texts may hold, come last.
    """
    one = docs.join(exact(docs).select("doc_id"), "doc_id", "left_semi")
    t = min(jaccard, containment)
    sets = written(shingle_sets(one, size), "shingles")  # opened for the prefix, whole for the verification
    rows = sets.selectExpr("doc_id", "explode(set_) as shingle")
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df_"))
    ranked = rows.join(often, "shingle").selectExpr("doc_id", "shingle", "row_number() over (partition by doc_id order by df_, shingle) as r_", "count(1) over (partition by doc_id) as n_", "df_")
    shared = ranked.where("df_ > 1").selectExpr("doc_id", "shingle", "n_", f"r_ <= n_ - ceil({t}D * n_) + 1 as head_")
    a, b = shared.where("head_").selectExpr("doc_id as p", "shingle", "n_ as np"), shared.selectExpr("doc_id as q", "shingle", "n_ as nq")
    # the smaller side's head against all of the larger: what both share is at least t of the smaller
    some = a.join(b, "shingle").where(f"(np < nq or np = nq and p < q) and (np >= {jaccard}D * nq or np >= {least})").select("p", "q", "np", "nq").distinct()
    some = some.selectExpr("least(p, q) as a", "greatest(p, q) as b", "if(p < q, np, nq) as na", "if(p < q, nq, np) as nb")
    # a pair carries both sets, so no shingle is a key again
    met = some.join(sets.withColumnsRenamed({"doc_id": "a", "set_": "x_"}), "a").join(sets.withColumnsRenamed({"doc_id": "b", "set_": "y_"}), "b").withColumn("both_", F.expr("size(array_intersect(x_, y_))"))
    met = met.selectExpr("a", "b", "both_ / (na + nb - both_) as jaccard", "both_ / least(na, nb) as containment", "least(na, nb) as smaller_")
    return met.where(f"jaccard >= {jaccard}D or containment >= {containment}D and smaller_ >= {least}").drop("smaller_")


def thread_key(c: str) -> str:
    """Subject without reply and forward prefixes, case- and space-folded; null if nothing is left."""
    bare = rf"regexp_replace({c}, '^([ \\t\\n\\x0B\\f\\r]*(?i:re|fwd|fw|aw|wg|antw)[ \\t\\n\\x0B\\f\\r]*(\\[[0-9]+\\])?[ \\t\\n\\x0B\\f\\r]*:[ \\t\\n\\x0B\\f\\r]*)+', '')"
    return f"nullif({keys.n1(bare)}, '')"


def draw(units: DataFrame, budget: int, cap: int, seed: int) -> DataFrame:
    """``units(unit, mailbox, size)`` -> those taken: in digest order at most ``cap`` of a mailbox, as long as whole units fit the budget of documents.

    A mailbox's first ``cap`` come from its least digests; the budget is met by
    sums over range partitions of the digest order.
    """
    rows = units.selectExpr("*", f"sha2(concat('{seed}|', cast(unit as string)), 256) as d_")
    rows = rows.selectExpr("*", "row_number() over (partition by mailbox order by d_, unit) as r_").where(f"r_ <= {cap}")
    before = ranked_sums(rows, "d_", "size")
    return rows.join(before, "d_").where(f"before_ + size <= {budget}").select(*(f"`{c}`" for c in units.columns))


def sections(headings: DataFrame) -> DataFrame:
    """``doc_id, start, label, text_len`` -> sections, each to the next heading; empty ones are dropped."""
    rows = headings.selectExpr("doc_id", "start", "label", "lead(start, 1, text_len) over (partition by doc_id order by start, label) as end")
    return rows.where("end > start")
