"""Exact removal of repeated word windows by De Bruijn path compaction.

Edges are the windows of ``window`` consecutive words.  A document is a walk;
consecutive edges whose least-hashed ``seed`` words (their minimiser) lie at
the same place form one path piece, as in minimiser-partitioned compaction of
De Bruijn graphs (BCALM).  Equal windows have equal minimisers at equal places,
so only pieces whose minimiser occurs twice can hold a repeated edge, and the
join with the repeated minimisers drops all others.

Pieces with equal minimiser and equal words are one class.  All but the first
occurrence of a class are repeated whole: the path does not branch, and no edge
of it is handled singly.  Where one minimiser has several classes the graph may
branch; there only the first occurrence of every class is opened into its
edges, which are compared one by one.  Pieces that follow each other in a
document and in their source are compacted to long spans, and both source
coordinates of every span are compared by a 128-bit digest of the words
themselves before anything is removed.

No step groups raw rows by a minimiser or a document's copies: counts combine
before the shuffle, and the joins' other side has one row for each key.

Cases: null or blank text has no words; texts shorter than a window keep all;
a null id is an id of its own and comes first; rows repeating id and text are
one document and each keeps what is kept; rows sharing an id but not the text
are ordered by a hash of the text; an empty table gives an empty table; columns
other than id and text are carried or ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Scratch, free_prefix
from ._words import Rolling, mix, slices, split_words, word_hashes

WINDOW = 20
SEED_WORDS = 6
#: Keys of over this many rows, and of over 1 / ``HOT_SHARE`` of a task's even share of them, are dealt over ``SALT`` tasks.
HOT_LEAST, HOT_SHARE, SALT = 512, 4, 64
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_PLACE = np.uint64((1 << 28) - 1)


def _second(hashes: np.ndarray) -> Rolling:
    return Rolling(mix(hashes + np.uint64(7)), _BASES[1])


def path_pieces(hashes: np.ndarray, bounds: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Minimiser hash, words' hash, first window and number of windows of every path piece."""
    n, width = len(hashes), window - seed + 1
    ends = np.repeat(bounds[1:], np.diff(bounds))
    first = np.arange(n)
    first = first[first + window <= ends]
    if not len(first):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    at = np.arange(n - seed + 1)
    value = Rolling(hashes, _BASES[0]).span(at, at + seed)
    least, span = (value & ~_PLACE) | at.astype(np.uint64), 1
    while span * 2 <= width:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    place = (least[first] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(first) != 1) | (np.diff(place) != 0)]))
    size = np.diff(np.append(new, len(first)))
    start = first[new]
    return value[place[new]], _second(hashes).span(start, start + size + window - 1), start, size


def _pieces(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, bounds = split_words(part.column("text"))
                anchor, content, start, size = path_pieces(word_hashes(words), bounds, window, seed)
                row = np.searchsorted(bounds, start, "right") - 1
                at = ((start - bounds[row]) << 8) | size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), *(part.column(c).take(pa.array(row)) for c in ("doc_id", "mark")), pa.array(at)],
                    ["anchor", "content", "doc_id", "mark", "at"],
                )

    return run


def _edges(window: int):
    """Opens the listed pieces of each document into single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, bounds = split_words(part.column("text"))
                lists = part.column("pieces")
                pieces = lists.flatten()
                row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
                at = pieces.field("at").to_numpy(zero_copy_only=False)
                size = at & 255
                pick = np.repeat(np.arange(len(at)), size)
                step = np.arange(len(pick)) - np.repeat(np.cumsum(size) - size, size)
                place = (at >> 8)[pick] + step
                start = bounds[row[pick]] + place
                value = _second(word_hashes(words)).span(start, start + window)
                yield pa.RecordBatch.from_arrays(
                    [pieces.field("anchor").take(pa.array(pick)), pa.array(value.view(np.int64)), *(part.column(c).take(pa.array(row[pick])) for c in ("doc_id", "mark")), pa.array((place << 8) | 1)],
                    ["anchor", "content", "doc_id", "mark", "at"],
                )

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 128-bit digest of the words of each requested span."""
    for batch in batches:
        for part in slices(batch):
            out: list[bytes] = []
            for text, asked in zip(pc.fill_null(part.column("text"), "").cast(pa.binary()).to_pylist(), part.column("asked").to_pylist(), strict=True):
                words = text.split()
                joined = b" ".join(words)
                stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                for x in asked:
                    begin = int(stops[x["place"] - 1]) if x["place"] else 0
                    out.append(xxhash.xxh3_128_digest(joined[begin : int(stops[x["place"] + x["n_words"] - 1]) - 1]))
            lists = part.column("asked")
            row = pa.array(np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets))))
            spans = lists.flatten()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(row), part.column("mark").take(row), spans.field("place"), spans.field("n_words"), pa.array(out, pa.binary())],
                ["doc_id", "mark", "place", "n_words", "digest"],
            )


def _cut(carry: list[str], own: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, own + "text"):
                total, gone, digest, kept_text = [], [], [], []
                texts = part.column(own + "text").cast(pa.binary()).to_pylist()
                for text, spans in zip(texts, part.column(own + "spans").to_pylist(), strict=True):
                    words = (text or b"").split()
                    total.append(len(words))
                    if spans:
                        keep = np.zeros(len(words) + 1, np.int32)
                        for s in spans:
                            keep[s["place"]] += 1
                            keep[s["place"] + s["n_words"]] -= 1
                        left = [words[i] for i in np.flatnonzero(np.cumsum(keep[:-1]) == 0)]
                        changed = len(left) < len(words)
                        words = left
                    else:
                        changed = False
                    joined = b" ".join(words)
                    gone.append(total[-1] - len(words))
                    digest.append(hashlib.sha256(joined).hexdigest())
                    if with_text:
                        kept_text.append(joined if changed else text)
                arrays = [part.column(c) for c in carry] + [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
                names = [*carry, *(own + c for c in ("n_words", "n_removed", "sha"))]
                if with_text:
                    arrays, names = [*arrays, pa.array(kept_text, pa.binary()).cast(pa.string())], [*names, own + "kept"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _mark(text: str) -> Column:
    """64 bits that tell apart different texts under one id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _counted_join(rows: DataFrame, counts: DataFrame, partitions: int) -> DataFrame:
    """``rows`` whose anchor is in ``counts(anchor, times)``: anchors that hold much more than a task's share are dealt over ``SALT`` tasks.

    At most ``HOT_SHARE`` anchors a partition can hold that much, so their list is broadcast.
    """
    total = counts.agg(F.sum("times")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("times") > max(HOT_LEAST, total // (HOT_SHARE * partitions))).select("anchor", F.lit(True).alias("hot")))
    salted = rows.join(hot, "anchor", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALT))).otherwise(F.lit(0)))
    copies = counts.select("anchor").join(hot, "anchor", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))))
    return salted.drop("hot").join(copies.select("anchor", F.col("salt").cast("long")), ["anchor", "salt"]).drop("salt")


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & (a[n].eqNullSafe(b[n]) if n == "doc_id" else a[n] == b[n])
    return out


def repeated_spans(spark: SparkSession, docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """``docs(doc_id, text)`` -> spans ``(doc_id, mark, place, n_words)`` to remove, verified at both coordinates."""
    scratch = Scratch(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", _mark("text").alias("mark"))
    schema = f"anchor long, content long, doc_id {kind}, mark long, at long"
    pieces = scratch.keep(rows.mapInArrow(_pieces(window, seed), schema), "pieces")
    # written first: a join can split a hot key only where both sides are plain shuffles
    often = scratch.keep(pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "often")
    shared = scratch.keep(_counted_join(pieces, often, partitions), "shared")
    scratch.drop(pieces, often)

    first = F.min(F.struct("doc_id", "mark", "at")).alias("first")
    classes = shared.groupBy("anchor", "content").agg(first, F.count(F.lit(1)).alias("times"))
    classes = scratch.keep(classes, "classes")
    kinds = scratch.keep(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "kinds")
    open_ = _counted_join(classes.select("anchor", "first.*"), kinds, partitions)
    open_ = open_.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("anchor", "at")).alias("pieces"))
    opened = rows.join(open_, _same(rows, open_, "doc_id", "mark")).select(rows["doc_id"], "text", rows["mark"], "pieces")
    edges = scratch.keep(opened.mapInArrow(_edges(window), schema), "edges")

    def later(all_: DataFrame, firsts: DataFrame) -> DataFrame:
        firsts = firsts.where("times > 1").select("anchor", "content", "first")
        met = all_.join(firsts, ["anchor", "content"]).where(~F.struct("doc_id", "mark", "at").eqNullSafe(F.col("first")))
        return met.select("doc_id", "mark", "at", F.col("first.doc_id").alias("src_id"), F.col("first.mark").alias("src_mark"), F.col("first.at").alias("src_at"))

    whole = scratch.keep(later(shared, classes), "whole")
    scratch.drop(shared, classes, kinds)
    firsts = edges.groupBy("anchor", "content").agg(first, F.count(F.lit(1)).alias("times")).where("times > 1")
    firsts = scratch.keep(firsts, "firsts")
    found = whole.unionAll(later(edges, firsts))
    found = found.select(
        "doc_id", "mark", F.shiftright("at", 8).alias("place"), F.col("at").bitwiseAND(F.lit(255)).alias("size"), "src_id", "src_mark", F.shiftright("src_at", 8).alias("src_place")
    )
    spans = scratch.keep(_compacted(found, window), "spans")
    scratch.drop(whole, edges, firsts)
    return _verified(spark, scratch, rows, spans)


def _compacted(found: DataFrame, window: int) -> DataFrame:
    """Pieces that continue each other at both coordinates become one span."""
    from pyspark.sql import Window

    way = Window.partitionBy("doc_id", "mark", "src_id", "src_mark", F.col("place") - F.col("src_place")).orderBy("place")
    reach = F.max(F.col("place") + F.col("size")).over(way.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", F.coalesce((F.col("place") > reach).cast("int"), F.lit(1)))
    found = found.withColumn("path", F.sum("new").over(way.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        found.groupBy("doc_id", "mark", "src_id", "src_mark", (F.col("place") - F.col("src_place")).alias("shift"), "path")
        .agg(F.min("place").alias("place"), F.max(F.col("place") + F.col("size") + window - 1).alias("stop"))
        .select("doc_id", "mark", "place", (F.col("stop") - F.col("place")).alias("n_words"), "src_id", "src_mark", (F.col("place") - F.col("shift")).alias("src_place"))
    )


def _verified(spark: SparkSession, scratch: Scratch, rows: DataFrame, spans: DataFrame) -> DataFrame:
    own = spans.select("doc_id", "mark", "place", "n_words")
    source = spans.select(F.col("src_id").alias("doc_id"), F.col("src_mark").alias("mark"), F.col("src_place").alias("place"), "n_words")
    asked = own.unionAll(source).distinct().groupBy("doc_id", "mark").agg(F.collect_list(F.struct("place", "n_words")).alias("asked"))
    met = rows.join(asked, _same(rows, asked, "doc_id", "mark")).select(rows["doc_id"], "text", rows["mark"], "asked")
    kind = rows.schema["doc_id"].dataType.simpleString()
    digests = met.mapInArrow(_digests, f"doc_id {kind}, mark long, place long, n_words long, digest binary")
    digests = scratch.keep(digests.distinct(), "digests")
    a, b = digests, digests.select(F.col("doc_id").alias("src_id"), F.col("mark").alias("src_mark"), F.col("place").alias("src_place"), "n_words", F.col("digest").alias("src_digest"))
    with_own = spans.join(a, _same(spans, a, "doc_id", "mark", "place", "n_words")).select(*(spans[c] for c in spans.columns), "digest")
    good = with_own.join(
        b, with_own["src_id"].eqNullSafe(b["src_id"]) & (with_own["src_mark"] == b["src_mark"]) & (with_own["src_place"] == b["src_place"]) & (with_own["n_words"] == b["n_words"])
    ).where("digest = src_digest")
    out = scratch.keep(good.select("doc_id", "mark", "place", with_own["n_words"]).distinct(), "verified")
    scratch.drop(spans, digests)
    return out


def substring_dedup(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED_WORDS, with_text: bool = False
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked for, all columns with the text left.

    With ``with_text`` the columns of ``docs`` come back under their names, the
    text with its repeated words removed (other texts byte for byte), followed
    by ``n_words``, ``n_removed`` and ``kept_sha256`` unless such columns exist.
    """
    own = free_prefix(docs.columns)
    if not with_text:
        docs, id_col, text_col = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text"
    spans = repeated_spans(spark, docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), window, seed)
    spans = spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("place", "n_words")).alias(own + "spans"))
    spans = spans.withColumnsRenamed({"doc_id": own + "id", "mark": own + "of"})
    carry = [c for c in docs.columns if c != text_col]
    rows = docs.withColumnRenamed(text_col, own + "text")
    rows = rows.withColumn(own + "mark", _mark(own + "text"))
    met = rows.join(spans, rows[f"`{id_col}`"].eqNullSafe(spans[own + "id"]) & (rows[own + "mark"] == spans[own + "of"]), "left")
    met = met.select(*(F.col(f"`{c}`") for c in carry), own + "text", own + "spans")
    schema = T.StructType([*(met.schema[c] for c in carry), *(T.StructField(own + n, T.LongType()) for n in ("n_words", "n_removed")), T.StructField(own + "sha", T.StringType())])
    if with_text:
        schema = schema.add(own + "kept", T.StringType())
    out = met.mapInArrow(_cut(carry, own, with_text), schema)
    extra = {own + "n_words": "n_words", own + "n_removed": "n_removed", own + "sha": "kept_sha256"}
    if not with_text:
        return out.withColumnsRenamed(extra)
    names = [F.col(own + "kept").alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*names, *(F.col(a).alias(b) for a, b in extra.items() if b not in docs.columns))
