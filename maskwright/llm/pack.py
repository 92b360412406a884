"""Best-fit packing planned over a histogram of lengths.

Documents are encoded, cut only where longer than a sequence, and counted by
length.  Best-fit decreasing runs over the counts: all pieces of one length are
placed together, each run into the fullest sequences that still take it, so
planning costs grow with the number of lengths and not of documents.  Every
piece then takes the slot of its rank within its length: ranks come from counts
by task and length, and a run's arithmetic turns a rank into sequence and
offset.

Cases: null text is empty and still has the end id; empty texts make pieces of
length one; repeated rows are packed each; a null id is carried; an empty table
gives an empty one; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch
from ._tokens import END_ID, default_tokenizer, encoded

SEQUENCE = 4096

#: A run: pieces ``rank .. rank + bins * each`` of one length go, ``each`` by ``each``, to sequences from ``sequence`` on, at ``offset`` and after.
RUN = ("length", "rank", "bins", "each", "sequence", "offset")


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, ...]]:
    """Best-fit decreasing over ``{length: count}`` -> runs (see ``RUN``), ordered by length (descending) and rank."""
    free: dict[int, list[tuple[int, int]]] = {}  # space left -> ranges (first sequence, how many)
    spaces: list[int] = []
    opened, runs = 0, []

    def put(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= size:
            raise ValueError(f"length {length} doesn't fit {size}")
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, count = free[space].pop()
                if not free[space]:
                    del free[space], spaces[at]
            else:
                space, first, count = size, opened, -(-left // (size // length))
                opened += count
            each = min(space // length, left)
            bins = min(count, left // each)
            runs.append((length, rank, bins, each, first, size - space))
            put(space, first + bins, count - bins)
            put(space - each * length, first, bins)
            left, rank = left - bins * each, rank + bins * each
    return runs


def _pieces(path: str, size: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size + 1, np.int64)
        task = TaskContext.get().partitionId()
        for part, ids, bounds in encoded(batches, path, end_id):
            raw = ids.astype("<u4").tobytes()
            total = np.diff(bounds)
            count = -(-total // size)
            row = np.repeat(np.arange(part.num_rows), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * size
            length = np.minimum(total[row] - start, size)
            begin = bounds[row] + start
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            by = length[order]
            new = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if len(by) else np.zeros(0, int)
            many = np.diff(np.append(new, len(by)))
            nth = np.empty(len(by), np.int64)
            nth[order] = np.arange(len(by)) - np.repeat(new, many) + np.repeat(seen[by[new]], many)
            seen[by[new]] += many
            arrays = [part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(nth)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int64))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _placed(runs: list[tuple[int, ...]]):
    table = np.array(runs or [(0,) * 6], np.int64)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks = table[:, 0], table[:, 1]
        firsts, where = np.unique(lengths, return_index=True)
        stops = np.append(where[1:], len(table))
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            for x in np.unique(length):
                i = np.searchsorted(firsts, x)
                pick = np.flatnonzero(length == x)
                at[pick] = where[i] + np.searchsorted(ranks[where[i] : stops[i]], rank[pick], "right") - 1
            r = table[at]
            step = rank - r[:, 1]
            sequence, offset = r[:, 4] + step // r[:, 3], r[:, 5] + step % r[:, 3] * length
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return run


def best_fit_pack(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids`` if asked for)."""
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    ids = ", ids array<long>" if with_ids else ""
    pieces = rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), size, end_id, with_ids), f"{schema}, task int, nth long{ids}")
    pieces = scratch.keep(pieces, "pieces")
    counts = scratch.keep(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``size`` rows
    # the table grows with tasks and lengths, so it meets the pieces by shuffle whatever its files' size
    ranked = pieces.hint("merge").join(base, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), (F.col("nth") + F.col("base")).alias("rank")
    )
    return ranked.mapInArrow(_placed(plan(histogram, size)), f"{schema}{ids}, sequence_id long, offset long")
