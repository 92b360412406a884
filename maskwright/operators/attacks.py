"""Re-identification attacks: dictionary, frequency, profile linkage and candidate ranking."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import runs, weighed
from ..staging import written

# Words that carry no context.
STOP = (
    "the and for you are with this that have from was not but they will would there their what about which when your all can has had our out who get "
    "been more one time some had said may please thank thanks regards subject date message sent from mailto original http https com www enron"
).split()


def dictionary(release: DataFrame, candidates: DataFrame) -> DataFrame:
    """``release(type, surrogate, truth)`` and ``candidates(type, surrogate, guess, ord)``, both through one pipeline -> guesses.

    A surrogate's first candidate wins; unmatched surrogates stay, without a guess.
    """
    first = candidates.groupBy("type", "surrogate").agg(F.min_by("guess", "ord").alias("guess"))
    return release.select("type", "surrogate", "truth").distinct().join(first, ["type", "surrogate"], "left").withColumn("hit", F.coalesce(F.expr("guess = truth"), F.lit(False)))


def observe(release: DataFrame) -> DataFrame:
    """``surface, n``: name-like runs of one to three capitalised words in released texts."""
    word = r"[A-ZÀ-Þ][a-zß-ÿ\\x27’\\-]+"
    runs = release.selectExpr(rf"explode(regexp_extract_all(released, '({word}([ \\t\\n\\x0B\\f\\r]+{word}){{0,2}})', 1)) as surface")
    return runs.groupBy("surface").agg(F.count(F.lit(1)).alias("n"))


def prior(names: DataFrame, top: int | None = None) -> DataFrame:
    """``name, n`` -> normalised weights, summed over repeats, of the ``top`` heaviest names."""
    rows = names.groupBy("name").agg(F.sum("n").alias("n"))
    if top is not None:
        rows = rows.orderBy(F.desc("n"), "name").limit(top)
    total = rows.agg(F.sum("n").alias("total_"))
    return rows.join(F.broadcast(total)).selectExpr("name", "n / total_ as weight")


def degrade(prior_: DataFrame, top: int) -> DataFrame:
    """The ``top`` heaviest names of a prior, weights normalised anew."""
    return prior(prior_.selectExpr("name", "weight as n"), top)


#: Names that the spread of scores is taken over, by an even stride of about so many.
STRIDE = 2_000


def align(observed: DataFrame, prior_: DataFrame, phi: float) -> DataFrame:
    """Guess for every observed surface: of the names, sorted by expected count, the one whose score ``-|ln((n + 1) / (expected + 1))|`` is best.

    Abstains where best and runner-up differ by less than ``phi`` deviations of
    the scores.  Equal counts get equal guesses, and of names of one expected
    count only the last two can be best or runner-up (a tie goes to the later in
    (expected, name) order): so distinct counts meet distinct expected values,
    both few, in one sorted pass, each with the two nearest on either side.
    """
    total = observed.agg(F.sum("n").alias("all_"))
    names = prior_.where("weight > 0").join(F.broadcast(total)).selectExpr("weight * all_ as e", "name")
    values = names.groupBy("e").agg(F.count(F.lit(1)).alias("many"), F.max("name").alias("last")).selectExpr("cast(e as double) as e", "many", "last")
    counts = observed.groupBy("n").agg(F.count(F.lit(1)).alias("surfaces_"))

    def nearest(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(frames)).to_pandas()
        v, c = table[table["n"].isna()].sort_values(["e", "last"]), table[table["n"].notna()]
        e, many, last = v["e"].to_numpy(float), v["many"].to_numpy(np.int64), v["last"].to_numpy(object)
        if not len(e):
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"n": c["n"].astype(np.int64), "guess": None, "abstains": True}), schema=out, preserve_index=False)
            return
        size = int(many.sum())
        ends = np.cumsum(many)
        sample = e[np.searchsorted(ends, np.arange(0, size, max(1, size // STRIDE)), "right")]
        rows = []
        for n in c["n"].astype(np.int64).tolist():
            at = int(np.searchsorted(e, n, "left"))
            near = []
            for i in range(max(0, at - 2), min(len(e), at + 3)):
                near += [(-abs(np.log(n + 1) - np.log(e[i] + 1)), i)] * int(min(many[i], 2))
            near.sort(reverse=True)
            scores = -np.abs(np.log(n + 1) - np.log(sample + 1))
            sd, best = float(scores.std()), near[0][0]
            lead = best - near[1][0] if len(near) > 1 else 0.0
            rows.append((n, last[near[0][1]], bool(sd > 0 and lead / sd < phi or sd == 0)))
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["n", "guess", "abstains"]), schema=out, preserve_index=False)

    out = pa.schema([("n", pa.int64()), ("guess", pa.string()), ("abstains", pa.bool_())])
    # one row for each distinct count and each distinct expected value
    both = counts.selectExpr("n", "cast(null as double) as e", "cast(null as bigint) as many", "cast(null as string) as last").unionAll(values.selectExpr("cast(null as bigint) as n", "e", "many", "last"))
    pick = both.repartition(1).mapInArrow(nearest, "n long, guess string, abstains boolean")
    return observed.join(pick, "n").select("surface", "n", "guess", "abstains")


def a2_score(aligned: DataFrame, truth: DataFrame, candidates: int) -> DataFrame:
    """``truth(surface, entity, real)`` (``real``: a name left as it was) -> counts of outcomes, accuracies and c@1.

    A surface with one entity guessed right is 1-to-1, with several 1-to-many;
    an entity behind several surfaces makes it many-to-.  Names left in the
    clear count as recovered by reading but not by alignment.
    """
    per = truth.groupBy("surface").agg(F.collect_set(F.expr("if(real, null, entity)")).alias("entities"), F.max(F.col("real").cast("int")).alias("left_"))
    spread = truth.where("not real").groupBy("entity").agg(F.countDistinct("surface").alias("surfaces"))
    lone = truth.where("not real").join(spread, "entity").groupBy("surface").agg(F.max("surfaces").alias("surfaces"))
    rows = aligned.join(per, "surface", "left").join(lone, "surface", "left")
    rows = rows.selectExpr("*", "coalesce(size(entities) = 0 and left_ = 1, false) as read_", "coalesce(array_contains(entities, guess), false) and not abstains as right_")
    rows = rows.selectExpr("*", "case when read_ then 'undetected' when abstains then 'abstained' when right_ then concat(if(surfaces > 1, 'many', '1'), '_to_', if(size(entities) > 1, 'many', '1')) else 'wrong' end as outcome")
    kinds = ["1_to_1", "1_to_many", "many_to_1", "many_to_many", "wrong", "abstained", "undetected"]
    out = rows.agg(F.count(F.lit(1)).alias("observed"), *(F.count_if(F.col("outcome") == k).alias(f"n_{k}") for k in kinds))
    out = out.selectExpr("*", "n_1_to_1 + n_1_to_many + n_many_to_1 + n_many_to_many as aligned_", "observed - n_abstained as attempted").selectExpr("*", "aligned_ + n_undetected as correct")
    return out.selectExpr(
        "observed", "attempted", *(f"n_{k}" for k in kinds), "correct", "correct / nullif(attempted, 0) as accuracy_attempted", "aligned_ / nullif(attempted - n_undetected, 0) as accuracy_alignment",
        "(correct + correct / observed * n_abstained) / observed as c_at_1", f"1D / {candidates} as chance",
    )


def neighbours(mentions: DataFrame) -> DataFrame:
    """``entity, other, w``: once for every mention and other entity of its document."""
    per = mentions.groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("m"))
    a, b = per.alias("a"), per.alias("b")
    return a.join(b, F.expr("a.doc_id = b.doc_id and a.entity <> b.entity")).groupBy("a.entity", F.col("b.entity").alias("other")).agg(F.sum("a.m").alias("w"))


_CONTEXT = re.compile(r"[A-Za-z][A-Za-z'\-]{2,}")


def context(docs: DataFrame, mentions: DataFrame, reach: int = 120, by: tuple[str, ...] = ("entity",)) -> DataFrame:
    """``entity, term, n`` (or other columns of the mentions than ``entity``): words within ``reach`` characters of an entity's mentions, stop words left out.

    A document's mentions travel to its text, which is read once; counts are
    summed in the document before they are shuffled.
    """
    listed = mentions.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", *by)).alias("m_"))
    rows = docs.select("doc_id", "text").join(listed, "doc_id").select("text", "m_")
    stop = frozenset(STOP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in runs(whole, weighed(whole, "m_"))):
            lists = batch.column("m_")
            flat, sizes = lists.flatten(), lists.value_lengths().to_pylist()
            places = list(zip(flat.field("start").to_pylist(), flat.field("end").to_pylist(), *(flat.field(c).to_pylist() for c in by), strict=True))
            at, keys, terms, counts = 0, [], [], []
            for text, size in zip(batch.column("text").to_pylist(), sizes, strict=True):
                held: Counter = Counter()
                for start, end, *key in places[at : at + size]:
                    near = text[max(0, start - reach) : start] + " " + text[end : end + reach]
                    held.update([(*key, w) for w in map(str.lower, _CONTEXT.findall(near)) if w not in stop])
                at += size
                for (*key, term), n in held.items():
                    keys.append(key)
                    terms.append(term)
                    counts.append(n)
            columns = [pa.array(list(c), flat.field(name).type) for name, c in zip(by, zip(*keys, strict=True), strict=True)] if keys else [pa.array([], flat.field(name).type) for name in by]
            whole = pa.RecordBatch.from_arrays([*columns, pa.array(terms, pa.string()), pa.array(counts, pa.int64())], [*by, "term", "n"])
            for i in range(0, max(len(terms), 1), 1 << 16):
                yield whole.slice(i, 1 << 16)

    kinds = ", ".join(f"`{c}` {mentions.schema[c].dataType.simpleString()}" for c in by)
    return rows.mapInArrow(run, f"{kinds}, term string, n long").groupBy(*by, "term").agg(F.sum("n").alias("n"))


def bags(docs: DataFrame, mentions: DataFrame, reach: int = 120, by: tuple[str, ...] = ("side", "entity")) -> DataFrame:
    """``by, terms``: the context words of ``context`` as one list of ``term, n`` for each entity.

    Lists travel, not words: those of a run of documents are merged before the
    shuffle, and the sorted rows of an entity after it, one after the other.
    """
    listed = mentions.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", *by)).alias("m_"))
    rows = docs.select("doc_id", "text").join(listed, "doc_id").select("text", "m_")
    stop = frozenset(STOP)
    kinds = [mentions.schema[c].dataType.simpleString() for c in by]

    def batch_of(found: list[tuple[tuple, dict[str, int]]], types: list[pa.DataType]) -> pa.RecordBatch:
        terms = [t for _, held in found for t in held]
        counts = [n for _, held in found for n in held.values()]
        offsets = np.concatenate([[0], np.cumsum([len(held) for _, held in found])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["term", "n"]))
        return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k, _ in found], t) for i, t in enumerate(types)), lists], [*by, "terms"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in runs(whole, weighed(whole, "m_"))):
            lists = batch.column("m_")
            flat, sizes = lists.flatten(), lists.value_lengths().to_pylist()
            places = list(zip(flat.field("start").to_pylist(), flat.field("end").to_pylist(), *(flat.field(c).to_pylist() for c in by), strict=True))
            at, held = 0, defaultdict(Counter)
            for text, size in zip(batch.column("text").to_pylist(), sizes, strict=True):
                for start, end, *key in places[at : at + size]:
                    near = text[max(0, start - reach) : start] + " " + text[end : end + reach]
                    held[tuple(key)].update([w for w in map(str.lower, _CONTEXT.findall(near)) if w not in stop])
                at += size
            if held:
                yield batch_of(list(held.items()), [flat.field(c).type for c in by])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, many, types = [], 0, None
        for whole in batches:
            types = [whole.column(c).type for c in by]
            for batch in runs(whole, weighed(whole, "terms", None)):
                lists = batch.column("terms")
                flat = lists.flatten()
                terms, counts, at = flat.field("term").to_pylist(), flat.field("n").to_pylist(), 0
                for key, size in zip(zip(*(batch.column(c).to_pylist() for c in by), strict=True), lists.value_lengths().to_pylist(), strict=True):
                    mine = zip(terms[at : at + size], counts[at : at + size], strict=True)
                    at, many = at + size, many + size
                    if found and found[-1][0] == key:
                        held = found[-1][1]
                        for t, n in mine:
                            held[t] = held.get(t, 0) + n
                        continue
                    if many > 1 << 16 and found:
                        yield batch_of(found, types)
                        found, many = [], size
                    found.append((key, dict(mine)))
        if found:
            yield batch_of(found, types)

    schema = ", ".join(f"`{c}` {kind}" for c, kind in zip(by, kinds, strict=True)) + ", terms array<struct<term: string, n: bigint>>"
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.mapInArrow(read, schema).repartition(n, *by).sortWithinPartitions(*by).mapInArrow(merge, schema)


#: Ids of others held for one entity before repeats go.
UNION = 1 << 20


def _met_with(per: DataFrame, wanted: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``by, seen``: the distinct other entities in the documents of every ``wanted`` one.

    Entities are numbered, each wanted one of a document gets the document's
    numbers as one array, and an entity's arrays are united one after the other.
    """
    named = written(per.select(*by).distinct().join(wanted.withColumn("wanted_", F.lit(True)), list(by), "left").selectExpr(*by, "monotonically_increasing_id() as id_", "wanted_ is not null as wanted_"), "entities")
    listed = per.join(named, list(by)).groupBy("side", "doc_id").agg(F.collect_list("id_").alias("all_"), F.collect_list(F.expr("if(wanted_, id_, null)")).alias("of_"))
    n = int(per.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few bytes that become many: dealt over a fixed number of tasks, for by their size they would be put in one
    listed = listed.where("size(of_) > 0 and size(all_) > 1").repartition(n, "side", "doc_id")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, of in zip(batch.column("all_"), batch.column("of_"), strict=True):
                ids, mine = np.sort(held.values.to_numpy()), of.values.to_numpy()
                step = max(1, UNION // len(ids))
                for i in range(0, len(mine), step):
                    some = mine[i : i + step]
                    offsets = pa.array((np.arange(len(some) + 1) * len(ids)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.ListArray.from_arrays(offsets, pa.array(np.tile(ids, len(some))))], ["id_", "others"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, held, many = [], None, [], 0
        for batch in batches:
            ids, lists = batch.column("id_").to_numpy(), batch.column("others")
            flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            for i, key in enumerate(ids.tolist()):
                part = flat[ends[i - 1] if i else 0 : ends[i]]
                if key != at:
                    if at is not None:
                        out.append((at, len(np.unique(np.concatenate(held))) - 1))
                    at, held, many = key, [], 0
                held.append(part)
                many += len(part)
                if many > UNION:
                    held = [np.unique(np.concatenate(held))]
                    many = 0
            held = [np.unique(np.concatenate(held))] if held else held  # lets the batch go
            if len(out) >= 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out, strict=True)], ["id_", "seen"])
                out = []
        if at is not None:
            out.append((at, len(np.unique(np.concatenate(held))) - 1))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out, strict=True)], ["id_", "seen"])

    seen = listed.select("all_", "of_").mapInArrow(deal, "id_ long, others array<long>").repartition(n, "id_").sortWithinPartitions("id_").mapInArrow(unite, "id_ long, seen long")
    return seen.join(named, "id_").select(*by, "seen")


def structure(mentions: DataFrame, by: tuple[str, ...] = ("side", "entity")) -> DataFrame:
    """``mentions(side, entity, doc_id)`` -> ``side, entity, mentions, documents, degree, weight``.

    ``degree`` and ``weight`` count the other entities of its documents, once
    for every mention and other entity; but for entities of several documents
    they come from document totals, not from pairs.
    """
    per = mentions.groupBy("side", "doc_id", "entity").agg(F.count(F.lit(1)).alias("m"))
    rows = per.join(per.groupBy("side", "doc_id").agg(F.count(F.lit(1)).alias("k")), ["side", "doc_id"])
    counts = rows.groupBy(*by).agg(F.sum("m").alias("mentions"), F.count(F.lit(1)).alias("documents"), F.sum(F.expr("m * (k - 1)")).alias("weight"))
    # the degree is a count of distinct others: as many as its documents hold, less those met twice
    many = rows.where("k > 1").groupBy(*by).agg(F.count(F.lit(1)).alias("d"), F.sum(F.expr("k - 1")).alias("one"))
    shared = many.where("d > 1").select(*by)
    degree = _met_with(per, shared, by)
    return counts.join(many, list(by), "left").join(degree, list(by), "left").selectExpr(*by, "mentions", "documents", "coalesce(seen, one, 0) as degree", "weight")


def profiles(docs: DataFrame, mentions: DataFrame, reach: int = 120, by: tuple[str, ...] = ("side", "entity")) -> DataFrame:
    """``mentions(side, entity, doc_id, start, end)`` -> ``side, entity, mentions, documents, degree, weight, terms``: what an attacker sees of each (``structure``, ``bags``)."""
    return structure(mentions, by).join(bags(docs, mentions, reach, by), list(by), "left")


def vocabulary(profiles_: DataFrame, top: int) -> DataFrame:
    """``term, col``: the ``top`` most frequent context words of both sides, ties by name (so few that they are broadcast)."""
    total = profiles_.selectExpr("explode(terms) as t").groupBy("t.term").agg(F.sum("t.n").alias("total_")).orderBy(F.desc("total_"), "term").limit(top)
    return total.selectExpr("term", "row_number() over (order by total_ desc, term) - 1 as col")


def featurise(profiles_: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    """``side, entity, cols, ws``: log counts of the vocabulary and four structural features (columns ``top`` to ``top + 3``), of unit length, sparse.

    The vocabulary (``top`` rows at most) goes to the workers; a profile becomes
    a row where it is.
    """
    known = terms.collect()
    words, place = [r["term"] for r in known], np.array([r["col"] for r in known], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.array(words, pa.string())
        for batch in (part for whole in batches for part in runs(whole, weighed(whole, "terms", None))):
            lists, size = batch.column("terms"), batch.num_rows
            flat = lists.flatten()
            at = np.repeat(np.arange(size), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            col = pc.fill_null(pc.index_in(flat.field("term"), value_set=listed), -1).to_numpy(zero_copy_only=False)
            row, col, n = at[col >= 0], place[col[col >= 0]], flat.field("n").to_numpy(zero_copy_only=False)[col >= 0]
            for i, c in enumerate(("mentions", "documents", "degree", "weight")):
                row, col, n = np.concatenate([row, np.arange(size)]), np.concatenate([col, np.full(size, top + i)]), np.concatenate([n, batch.column(c).to_numpy(zero_copy_only=False)])
            w = np.log1p(n.astype(float))
            row, col, w = row[w > 0], col[w > 0], w[w > 0]
            by = np.lexsort((col, row))
            row, col, w = row[by], col[by], w[by]
            w = w / np.maximum(np.sqrt(np.bincount(row, w * w, size)), 1e-9)[row]
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=size))]).astype(np.int32))
            arrays = [batch.column("side"), batch.column("entity"), pa.ListArray.from_arrays(offsets, pa.array(col.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(w))]
            yield pa.RecordBatch.from_arrays(arrays, ["side", "entity", "cols", "ws"])

    return profiles_.select("side", "entity", "mentions", "documents", "degree", "weight", "terms").mapInArrow(run, "side string, entity string, cols array<int>, ws array<double>")


#: Entities of a block, and columns used by at least one in ``COMMON`` of a block's gallery (those are multiplied as a dense matrix).
RANKED, COMMON = 2048, 64


def _sparse(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, rows["cols"]), np.int64, len(rows))
    flat = lambda c, kind: np.concatenate([*rows[c].to_numpy(), []]).astype(kind)
    return np.repeat(np.arange(len(rows)), size), flat("cols", np.int64), flat("ws", float)


def similarity(queries: pd.DataFrame, gallery: pd.DataFrame) -> np.ndarray:
    """Dot products of sparse rows (``cols``, ``ws``): common columns by a dense product, the rest column by column."""
    (qi, qc, qw), (gi, gc, gw) = _sparse(queries), _sparse(gallery)
    width = int(max(qc.max(initial=-1), gc.max(initial=-1))) + 1
    often = np.bincount(gc, minlength=width) * COMMON >= len(gallery)
    slot = np.cumsum(often) - 1
    q, g = np.zeros((len(queries), int(often.sum()))), np.zeros((len(gallery), int(often.sum())))
    pick = often[qc]
    q[qi[pick], slot[qc[pick]]] = qw[pick]
    pick = often[gc]
    g[gi[pick], slot[gc[pick]]] = gw[pick]
    out = q @ g.T
    rest = ~often[gc]
    order = np.argsort(gc[rest], kind="stable")
    gi, gc, gw = gi[rest][order], gc[rest][order], gw[rest][order]
    rest = ~often[qc]
    qi, qc, qw = qi[rest], qc[rest], qw[rest]
    lo, hi = np.searchsorted(gc, qc, "left"), np.searchsorted(gc, qc, "right")
    n = hi - lo
    at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out += np.bincount(np.repeat(qi, n) * len(gallery) + gi[at], np.repeat(qw, n) * gw[at], out.size).reshape(out.shape)
    return out


def rank(features: DataFrame, weights: dict[int, float] | None = None) -> DataFrame:
    """``query, rank``: for each query entity whose truth is in the gallery, the truth's place by cosine in the whole gallery (ties by key, nine decimals).

    Each query carries the similarity to its truth; blocks of queries meet
    blocks of the gallery and return counts of better candidates, never pairs.
    """
    gallery = features.where("side = 'gallery'").selectExpr("entity", "cols", "ws")
    queries = features.where("side = 'query'").selectExpr("entity", "cols", "ws").join(gallery.selectExpr("entity", "cols as tc", "ws as tw"), "entity")
    n_q, n_g = (max(1, -(-x.count() // RANKED)) for x in (queries, gallery))
    q = queries.selectExpr("entity", "cols", "ws", "tc", "tw", f"pmod(xxhash64(entity), {n_q}) as a").groupBy("a").agg(F.collect_list(F.struct("entity", "cols", "ws", "tc", "tw")).alias("q"))
    g = gallery.selectExpr("entity", "cols", "ws", f"pmod(xxhash64(entity, 1), {n_g}) as b").groupBy("b").agg(F.collect_list(F.struct("entity", "cols", "ws")).alias("g"))
    # every block of queries against every block of the gallery: dealt over tasks by both
    left = q.selectExpr("a", "q", f"explode(sequence(0L, {n_g - 1}L)) as b")
    met_ = left.join(g.hint("merge"), "b").repartition(max(1, min(n_q * n_g, 100_000)), "a", "b")

    def weighted(rows: pd.DataFrame, cols: str, ws: str) -> list[np.ndarray]:
        out = [np.asarray(w, float) * np.array([weights.get(int(i), 1.0) for i in c]) for c, w in zip(rows[cols], rows[ws], strict=True)]
        return [w / max(float(np.linalg.norm(w)), 1e-9) for w in out]

    def better(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for mine, theirs in zip(frame["q"], frame["g"], strict=True):
                a, b = (pd.DataFrame.from_records(list(x)) for x in (mine, theirs))
                a, b = a.sort_values("entity"), b.sort_values("entity")
                if weights is not None:
                    a, b = a.assign(ws=weighted(a, "cols", "ws"), tw=weighted(a, "tc", "tw")), b.assign(ws=weighted(b, "cols", "ws"))
                truth = np.round([float(np.dot(*_aligned(*x))) for x in zip(a["cols"], a["ws"], a["tc"], a["tw"], strict=True)], 9)[:, None]
                sim = np.round(similarity(a, b), 9)
                before = b["entity"].to_numpy()[None, :] < a["entity"].to_numpy()[:, None]
                yield pd.DataFrame({"query": a["entity"].to_numpy(), "ahead": ((sim > truth) | (sim == truth) & before).sum(axis=1)})

    counted = met_.select("q", "g").mapInPandas(better, "query string, ahead long")
    return counted.groupBy("query").agg((F.sum("ahead") + 1).alias("rank"))


def _aligned(cols: np.ndarray, ws: np.ndarray, tc: np.ndarray, tw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both, i, j = np.intersect1d(cols, tc, assume_unique=True, return_indices=True)
    return np.asarray(ws)[i], np.asarray(tw)[j]


def rank_summary(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.count(F.lit(1)).alias("queries"), F.avg(F.expr("cast(rank = 1 as int)")).alias("rank1"), F.avg(F.expr("cast(rank <= 5 as int)")).alias("rank5"), F.avg(1 / F.col("rank")).alias("mrr"))
