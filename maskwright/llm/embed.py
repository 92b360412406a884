"""Near-duplicate embeddings by an epsilon grid order join.

Equal vectors of one label are first collapsed to one node with a count.
Cosine at least ``cosine`` of unit vectors is a distance of at most
``eps = sqrt(2 - 2 * cosine)``.  Unit vectors are rotated to principal axes of
their label (fitted on a sample of at most ``SAMPLE`` vectors; labels with few of
them share axes; any rotation keeps distances, so the fit affects speed only)
and sorted by the cells of a grid of side ``eps`` on the leading ``GRID`` axes,
within each label.  The sequence is cut into blocks of ``BLOCK`` vectors.

The join recurses over sequence intervals: starting from each label's whole
sequence against itself, every pair of intervals is replaced by the pairs of
their ``FAN`` parts, less those whose bounding boxes on the leading ``BOXED``
axes are more than ``eps`` apart.  Down to blocks every level is a DataFrame join
on intervals; within a pair of blocks numpy goes on by halves down to ``LEAF``
vectors, where boxes also bound the norm on all other axes.  What is left is
compared exactly in double precision.  A block pair returns link counts, and one
edge per linked vector to the least vector of its group within the pair, never
the pairs themselves.

Where vectors spread evenly over many axes no box bounds their distance and few
pairs of intervals are skipped; results don't depend on it.

Cases: a null label or a vector that is null, empty, zero, or holds null or
non-finite numbers links with nothing; vectors of different length don't link;
equal vectors link; repeated ids are separate rows; a null id names no group;
an empty table gives an empty one; only id, vector and label are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._graph import connected_components
from ._shared import Scratch

COSINE = 0.93
SAMPLE = 8192
GRID, BOXED, BLOCK, LEAF, FAN = 6, 12, 1024, 32, 4
#: Sampled vectors for each axis that a label needs to have axes of its own, and block pairs in an Arrow batch.
OWN_AXES, PAIRS_AT_ONCE = 4, 4
#: Slack for rounding when boxes are compared; the final comparison has none.
SLACK = 1e-6


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.ListArray) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


Axes = dict[tuple[object, int], np.ndarray]


def rotated(u: np.ndarray, axes: Axes, label: object) -> np.ndarray:
    """Coordinates on the label's axes, on those of the length, or as they are where the length was not sampled."""
    turn = axes.get((label, u.shape[1]), axes.get((None, u.shape[1])))
    return u if turn is None else u @ turn


def fit_axes(rows: list[tuple[object, int, list[float]]]) -> Axes:
    """Principal axes, largest first, of every length and of the labels with many of ``(label, length, vector)``."""
    held: dict[tuple[object, int], list] = {}
    for label, d, vector in rows:
        held.setdefault((None, d), []).append(vector)
        held.setdefault((label, d), []).append(vector)
    out: Axes = {}
    for (label, d), some in held.items():
        if label is None or len(some) >= OWN_AXES * d:
            x = unit(np.array(some, np.float64))
            out[label, d] = np.linalg.eigh(np.cov(x, rowvar=False).reshape(d, d) if len(x) > 1 else np.eye(d))[1][:, ::-1]
    return out


def _project(axes: Axes, eps: float):
    """Adds grid cells and leading coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds: dict[tuple[object, int], list[int]] = {}
            for i, kind in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True)):
                kinds.setdefault(kind, []).append(i)
            boxed = np.zeros((batch.num_rows, BOXED))
            for (label, d), pick in kinds.items():
                lead = min(BOXED, d)
                boxed[pick, :lead] = rotated(unit(_matrix(batch.column("embedding").take(pa.array(pick)))), axes, label)[:, :lead]
            cells = np.floor(boxed[:, :GRID] / eps).astype(np.int16)
            names = [*batch.schema.names, *(f"c{i}" for i in range(GRID)), *(f"z{i}" for i in range(BOXED))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cells[:, i]) for i in range(GRID)), *(pa.array(boxed[:, i]) for i in range(BOXED))], names)

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the sorted vectors, and blocks of them that don't cross labels."""
    base = TaskContext.get().partitionId() << 40
    row, block, held, last = 0, -1, 0, None
    for batch in batches:
        keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
        blocks = np.empty(len(keys), np.int64)
        for i, key in enumerate(keys):
            if key != last or held == BLOCK:
                block, held, last = block + 1, 0, key
            held += 1
            blocks[i] = base + block
        nodes = base + row + np.arange(len(keys))
        row += len(keys)
        keep = [c for c in batch.schema.names if c[0] != "c" or not c[1:].isdigit()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(nodes), pa.array(blocks)], [*keep, "node", "block"])


def _boxes(z: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest coordinates, and norm on the other axes, of every ``size`` rows in turn."""
    lead = np.column_stack([z[:, :BOXED], np.linalg.norm(z[:, BOXED:], axis=1)])
    at = np.arange(0, len(z), size)
    return np.minimum.reduceat(lead, at), np.maximum.reduceat(lead, at)


def near_leaves(z: np.ndarray, y: np.ndarray, eps: float, same: bool) -> np.ndarray:
    """Pairs of leaves (rows ``i * LEAF`` and on) of two blocks of rotated vectors that may hold links: recursion by halves."""
    size = LEAF
    while size < max(len(z), len(y)):
        size *= 2
    pairs = np.zeros((1, 2), np.int64)
    while True:
        (a0, a1), (b0, b1) = _boxes(z, size), _boxes(y, size)
        i, j = pairs.T
        gap = np.maximum(np.maximum(a0[i] - b1[j], b0[j] - a1[i]), 0.0)
        pairs = pairs[(gap * gap).sum(axis=1) <= (eps + SLACK) ** 2]
        if size == LEAF:
            return pairs
        size //= 2
        pairs = (pairs[:, None, :] * 2 + np.array([[0, 0], [0, 1], [1, 0], [1, 1]])).reshape(-1, 2)
        pairs = pairs[(pairs[:, 0] * size < len(z)) & (pairs[:, 1] * size < len(y))]
        if same:
            pairs = pairs[pairs[:, 0] <= pairs[:, 1]]


def linked(x: np.ndarray, y: np.ndarray, z: np.ndarray, w: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` and ``y`` (rotated: ``z``, ``w``) whose cosine is at least ``cosine``; of a block against itself each pair twice, no row with itself."""
    leaves = near_leaves(z, w, float(np.sqrt(max(0.0, 2 - 2 * cosine))), same)
    across, down = -(-len(y) // LEAF), -(-len(x) // LEAF)
    if 2 * len(leaves) > down * across * (0.5 if same else 1.0):
        rows, cols = np.nonzero(x @ y.T >= cosine)
    else:
        found = []
        for i in np.unique(leaves[:, 0]):
            some = leaves[leaves[:, 0] == i, 1]
            at = (some[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < len(y)]
            r, c = np.nonzero(x[i * LEAF : (i + 1) * LEAF] @ y[at].T >= cosine)
            found.append((r + i * LEAF, at[c]))
        rows, cols = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        if same:  # leaves below the diagonal are mirrored
            off = rows // LEAF != cols // LEAF
            rows, cols = np.concatenate([rows, cols[off]]), np.concatenate([cols, rows[off]])
    keep = rows != cols if same else slice(None)
    return rows[keep], cols[keep]


def _compare(cosine: float, axes: Axes):
    def side(batch: pa.RecordBatch, name: str, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = batch.column(name).slice(i, 1).flatten()
        return rows.field("node").to_numpy(zero_copy_only=False), rows.field("times").to_numpy(zero_copy_only=False), unit(_matrix(rows.field("embedding")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, labels = batch.column("same").to_pylist(), batch.column("label").to_pylist()
            for i in range(batch.num_rows):
                a, m, x = side(batch, "left", i)
                b, n, y = (a, m, x) if same[i] else side(batch, "right", i)
                rows, cols = linked(x, y, rotated(x, axes, labels[i]), rotated(y, axes, labels[i]), cosine, same[i])
                if not len(rows):
                    continue
                degree_a, degree_b = np.bincount(rows, n[cols], len(a)), np.bincount(cols, m[rows], len(b))
                lab_a, lab_b = a.copy(), b.copy()
                while True:
                    new_a, new_b = lab_a.copy(), lab_b.copy()
                    np.minimum.at(new_a, rows, lab_b[cols])
                    np.minimum.at(new_b, cols, new_a[rows])
                    if (new_a == lab_a).all() and (new_b == lab_b).all():
                        break
                    lab_a, lab_b = new_a, new_b
                some_a, some_b = np.unique(rows), np.unique(cols)
                if same[i]:  # rows and columns are the same vectors
                    node, degree, root = a[some_a], degree_a[some_a], np.minimum(lab_a, lab_b)[some_a]
                else:
                    node, degree, root = np.concatenate([a[some_a], b[some_b]]), np.concatenate([degree_a[some_a], degree_b[some_b]]), np.concatenate([lab_a[some_a], lab_b[some_b]])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(degree.astype(np.int64)), pa.array(root)], ["node", "degree", "root"])

    return run


def block_pairs(meta: DataFrame, levels: int, eps: float) -> DataFrame:
    """``meta(label, dim, rank, lo*, hi*)`` -> pairs of ranks of one label that may hold links, by recursion over intervals."""
    lows, highs = [f"lo{i}" for i in range(BOXED)], [f"hi{i}" for i in range(BOXED)]
    pairs = meta.select("label", "dim").distinct().selectExpr("label", "dim", "0L as a", "0L as b")
    gaps = " + ".join(f"pow(greatest(0D, l.lo{i} - r.hi{i}, r.lo{i} - l.hi{i}), 2)" for i in range(BOXED))
    for level in range(levels - 1, -1, -1):
        boxes = meta.withColumn("at", F.floor(F.col("rank") / FAN**level)).groupBy("label", "dim", "at")
        boxes = boxes.agg(*(F.min(c).alias(c) for c in lows), *(F.max(c).alias(c) for c in highs))
        parts = pairs.selectExpr("label", "dim", f"explode(sequence(a * {FAN}, a * {FAN} + {FAN - 1})) as a", "b")
        parts = parts.selectExpr("label", "dim", "a", f"explode(sequence(b * {FAN}, b * {FAN} + {FAN - 1})) as b").where("a <= b")
        left, right = boxes.withColumnRenamed("at", "a").alias("l"), boxes.withColumnRenamed("at", "b").alias("r")
        pairs = parts.join(left, ["label", "dim", "a"]).join(right, ["label", "dim", "b"]).where(f"{gaps} <= {(eps + SLACK) ** 2}D").select("label", "dim", "a", "b")
    return pairs


def embedding_dedup(
    spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE
) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``."""
    scratch = Scratch(spark)
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    # null vectors and null or non-finite components make this null or false
    usable = F.expr("label is not null and embedding is not null and exists(embedding, x -> x <> 0) and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    valid = rows.where("usable").withColumn("dim", F.size("embedding"))
    distinct = scratch.keep(valid.groupBy("label", "dim", "embedding").agg(F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least")), "vectors")

    some = distinct.select("label", "dim", "embedding").orderBy(F.xxhash64("embedding"), "label").limit(SAMPLE).collect()
    axes = fit_axes([tuple(r) for r in some])

    own = f"label {kinds['label']}, dim int, embedding {kinds['embedding']}, times long, least {kinds['vec_id']}"
    grid, leading = ", ".join(f"c{i} short" for i in range(GRID)), ", ".join(f"z{i} double" for i in range(BOXED))
    placed = distinct.mapInArrow(_project(axes, eps), f"{own}, {grid}, {leading}")
    order = ["label", "dim", *(f"c{i}" for i in range(GRID)), *(f"z{i}" for i in range(GRID))]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    nodes = scratch.keep(placed.mapInArrow(_number, f"{own}, {leading}, node long, block long"), "nodes")

    boxes = nodes.groupBy("label", "dim", "block").agg(*(F.min(f"z{i}").alias(f"lo{i}") for i in range(BOXED)), *(F.max(f"z{i}").alias(f"hi{i}") for i in range(BOXED)))
    meta = scratch.keep(boxes.withColumn("rank", F.row_number().over(Window.partitionBy("label", "dim").orderBy("block")) - 1), "boxes")
    top = meta.agg(F.max("rank")).first()[0]
    levels = 1
    while top is not None and FAN**levels <= top:
        levels += 1
    pairs = block_pairs(meta, levels, eps)
    content = nodes.groupBy("block").agg(F.collect_list(F.struct("node", "times", "embedding")).alias("rows"))  # BLOCK rows at most
    content = content.join(meta.select("block", "label", "dim", "rank"), "block").drop("block")
    left, right = content.withColumnsRenamed({"rank": "a", "rows": "left"}), content.withColumnsRenamed({"rank": "b", "rows": "right"})
    met = pairs.join(left, ["label", "dim", "a"]).join(right, ["label", "dim", "b"])
    met = met.selectExpr("label", "left", "if(a = b, slice(right, 1, 0), right) as right", "a = b as same")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(PAIRS_AT_ONCE))  # rows are whole blocks
    try:
        found = scratch.keep(met.mapInArrow(_compare(cosine, axes), "node long, degree long, root long"), "links")
    finally:
        spark.conf.set(setting, before)

    parts = connected_components(spark, found.selectExpr("node as a", "root as b"))
    degrees = found.groupBy("node").agg(F.sum("degree").alias("degree"))
    named = nodes.select("node", "least").join(parts, "node").groupBy("root").agg(F.min("least").alias("group_least"))
    grouped = parts.join(named, "root").select("node", "group_least")
    table = nodes.select("node", "label", "embedding", "times", "least").join(degrees, "node", "left").join(grouped, "node", "left")
    table = scratch.keep(table.selectExpr("label", "embedding", "coalesce(degree, 0) + times - 1 as n_links", "coalesce(group_least, least) as component_id"), "groups")
    linked = valid.join(table, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").selectExpr("vec_id", "0L as n_links", "vec_id as component_id")
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
