"""SimHash near-duplicates linked through pivot distance tables.

Fingerprints are compared by their Hamming distances to reference
fingerprints.  For every fingerprint a table of such distances is computed
once.  The 64 bits are cut into ``BLOCKS`` blocks with eight references each;
two fingerprints that differ in at most two bits agree on the distances to all
references of at least ``BLOCKS - 2`` blocks, so they share the key of one
choice of blocks.  Pairs that share a key are discarded when any coordinate of
a second table (``GLOBAL`` references over all bits) differs by more than the
threshold, since distances to a pivot obey the triangle inequality; survivors
are verified by their exact distance.

Keys shared by more than ``CROWD`` fingerprints never form pairs.  Their
members emit all fingerprints within one bit; two fingerprints within two bits
share such a neighbour, and any two that share one are within two bits, so
linking each to the least of its neighbour's group loses and adds nothing.

Cases: null text and text without words get fingerprint zero, which links like
any other; fewer than three words make one shingle; a null id takes part and
names no component; repeated rows are kept; an empty table gives an empty one;
only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import connected_components
from ._shared import Scratch
from ._words import slices

SEED = 42
BLOCKS = 5
GLOBAL = 16
CROWD = 64


def fingerprint(words: list[bytes], size: int = 3) -> bytes:
    """Eight big-endian bytes: a bit is set if it is set in over half of the shingles' XXH64."""
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stops = np.cumsum(lengths)
    starts = (stops - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[i:j], SEED) for i, j in zip(starts, (stops[size - 1 :] - 1).tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            texts = pc.fill_null(part.column("text"), "").cast(pa.binary()).to_pylist()
            prints = np.frombuffer(b"".join([fingerprint(t.lower().split()) for t in texts]), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(prints)], ["doc_id", "mark", "fp"])


def _reference(k: int) -> int:
    """The k-th reference fingerprint: a fixed 64-bit value from a counter (splitmix)."""
    x = (k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ x >> 31


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _lanes(distances: list[str]) -> str:
    """Up to eight distances in the bytes of one long (SQL text, as all of these: one call each to the JVM)."""
    return "(" + " | ".join(f"shiftleft(cast({d} as bigint), {8 * i})" for i, d in enumerate(distances)) + ")"


def pivot_table(prints: DataFrame) -> DataFrame:
    """Adds ``near`` (one long of eight distances per block) and ``far`` (two longs of eight) to ``fp``."""
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    masks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    to = lambda ref, mask: f"bit_count((fp ^ {_signed(ref)}L) & {_signed(mask)}L)"
    near = [_lanes([to(_reference(8 * b + j), mask) for j in range(8)]) for b, mask in enumerate(masks)]
    far = [_lanes([to(_reference(1000 + 8 * i + j), (1 << 64) - 1) for j in range(8)]) for i in range(GLOBAL // 8)]
    return prints.selectExpr("*", f"array({', '.join(near)}) as near", f"array({', '.join(far)}) as far")


def _coordinates_close(a: str, b: str, limit: int) -> str:
    lane = lambda x, i: f"(shiftright({x}[{i // 8}], {8 * (i % 8)}) & 127)"
    return " and ".join(f"abs({lane(a, i)} - {lane(b, i)}) <= {limit}" for i in range(GLOBAL))


def links(spark: SparkSession, prints: DataFrame, distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """``prints(fp)``, distinct -> edges ``(a, b)`` that connect all fingerprints within ``distance`` (2 at most) bits."""
    if not 0 <= distance <= 2:
        raise ValueError("keys of blocks cover distances up to 2")
    scratch = Scratch(spark)
    keys = [f"xxhash64({n}, {', '.join(f'near[{b}]' for b in blocks)})" for n, blocks in enumerate(combinations(range(BLOCKS), BLOCKS - 2))]
    keyed = pivot_table(prints.select("fp")).selectExpr("fp", "far", f"explode(array({', '.join(keys)})) as key")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = scratch.keep(keyed.join(shared, "key"), "keyed")
    some = shared.where(F.col("n") <= crowd)
    left, right = some.select("key", "fp", "far"), some.select("key", F.col("fp").alias("fp2"), F.col("far").alias("far2"))
    pairs = (
        left.join(right, "key")
        .where(f"fp < fp2 and {_coordinates_close('far', 'far2', distance)}")
        .where(f"bit_count(fp ^ fp2) <= {distance}")
        .select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
        .distinct()
    )
    many = shared.where(F.col("n") > crowd).select("fp").distinct()
    flips = ", ".join(f"fp ^ shiftleft(1L, {i})" for i in range(64))
    if distance == 2:
        spread = many.selectExpr("fp", f"explode(array(fp, {flips})) as by")
        hubs = spread.groupBy("by").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
        crowded = spread.join(hubs, "by").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()
    elif distance == 1:  # the neighbour is a member itself
        spread = many.selectExpr("fp", f"explode(array({flips})) as by")
        crowded = spread.join(many.withColumnRenamed("fp", "by"), "by").select(F.col("by").alias("a"), F.col("fp").alias("b"))
    else:
        crowded = many.limit(0).select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    return pairs.unionAll(crowded)


def simhash_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint``, ``component_id``, ``group_root`` and ``mark``.

    ``component_id`` is the least id in the group of linked fingerprints,
    ``group_root`` the group's own key (a fingerprint), and ``mark`` a hash of
    the text, which tells rows of one id apart.
    """
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = scratch.keep(rows.mapInArrow(_fingerprints, f"doc_id {kind}, mark long, fp long"), "prints")
    distinct = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    parts = connected_components(spark, links(spark, distinct, distance))
    linked = distinct.join(parts.withColumnRenamed("node", "fp"), "fp")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(named, "root").select("fp", "root", "component_id")
    table = scratch.keep(
        distinct.join(linked, "fp", "left").select(
            "fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "fp").alias("group_root")
        ),
        "groups",
    )
    return rows.join(table, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_root", "mark"
    )
