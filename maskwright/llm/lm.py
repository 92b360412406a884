"""Language-model scores from an Elias-Fano n-gram trie.

Tokens are the words of a text, ASCII letters lower-cased, then one end; words
are known by a 64-bit hash.  The trie has ``ORDER`` levels and holds every
n-gram of the training texts, whatever its count.  Level one keeps the tokens'
hashes as Elias-Fano sequences, and exact counts as the steps of a second
monotone sequence.  A higher level keeps, in each shard, the contexts that
begin there, monotone pointers to each context's successors, and the successors
made monotone by their context's place.  An n-gram is found by successor search
inside its context's pointer range.

Probabilities are smoothed by absolute discounting, interpolated with the level
below: the share of a seen n-gram and the weight that its context leaves to the
level below are each quantised to a byte and meet at a query.  Level one adds
``ADD`` to its exact counts.

Counting and dealing: tasks count n-grams as sorted 64-bit keys and send them
compressed to shards by leading bits of the context's hash; one task builds one
shard.  A context followed by over ``HOT`` tokens is dealt over many shards by
leading bits of the word (each part is a context of its own there), so no shard
grows with one context.  The driver sees a row for each shard (some million
n-grams) and for each such context.  Below its shard's bits a context keeps 36
bits and a word 28, so a search for an n-gram that was never seen finds another
one with a chance of about 1e-4 (at most 0.4 % after the hottest contexts).

Levels are files in the shared folder.  A worker maps a shard when it looks
something up (reads it where the folder is not mounted), forgets the oldest
beyond ``MAPPED`` (``READ``) bytes, and looks up the n-grams of some million
bytes of text at a time, in order of their keys.

Cases: null text is empty and scores its end; a null id is neither held out nor
learned from; repeated rows count and are scored each; an empty table gives an
empty one; without training text every token is unknown; only the id and text
columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._elias import EliasFano, load, mounted, save, size_of
from ._shared import Scratch, new_path
from ._words import mix, slices, split_words, word_hashes

HELD, FOLDS = 0, 10
ORDER, DISCOUNT, ADD = 3, 0.5, 0.1
#: Bytes of text for a shard of level one, tokens for a shard of a higher level, n-grams a task counts before it sends them, tokens after a context that is dealt.
SHARD_BYTES, SHARD, FLUSH, HOT = 1 << 26, 1 << 21, 1 << 20, 1 << 20
#: Text that is scored at once, tokens looked up at once, and bytes of shards a worker keeps: mapped (pages the system may drop), or read where the folder is not mounted.
SCORED_BYTES, PIECE, MAPPED, READ = 4 << 20, 1 << 16, 16 << 30, 256 << 20
#: Bits of a context and of a word in a key.
CONTEXT, WORD = 36, 28
#: Reserved hashes of the end, and of the start as a context.
END, START = 0, 1
#: Steps of the byte codes of a decade of probability and of back-off weight.
P_STEP, B_STEP = 25, 50
_OF_P, _OF_B = 10 ** (-np.arange(256) / P_STEP), 10 ** (-np.arange(256) / B_STEP)
#: Tasks that add up the contexts which may be dealt at the next level.
SIDE = 8

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_NO_KEYS, _NO_COUNTS = np.zeros(0, U), np.zeros(0, np.int64)


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of all texts, each text closed by the end, and each text's first place."""
    words, bounds = split_words(pc.ascii_lower(pc.fill_null(part.column("text"), "")))
    hashes = word_hashes(words)
    hashes[hashes <= START] += U(2)
    out = np.full(len(hashes) + part.num_rows, END, U)
    keep = np.ones(len(out), bool)
    bounds = bounds + np.arange(len(bounds))
    keep[bounds[1:] - 1] = False
    out[keep] = hashes
    return out, bounds


def contexts(tokens: np.ndarray, bounds: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the ``level - 1`` tokens before each token (the start is one of them), and which tokens have that many."""
    place = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))
    before = lambda k: np.where(place >= k, np.concatenate([np.zeros(k, U), tokens[:-k]]) if k < len(tokens) else U(0), U(START))
    out = before(1)
    for k in range(2, level):
        out = mix(out * _ODD + mix(before(k) + U(k)))
    return out, place >= level - 2


# --- keys and their way through a shuffle -------------------------------------------------------


@dataclass
class Hot:
    """Contexts that are dealt: sorted hashes, bits of the word that deal them, tokens that follow, and the log10 weight left to the level below."""

    context: np.ndarray = field(default_factory=lambda: _NO_KEYS)
    bits: np.ndarray = field(default_factory=lambda: _NO_KEYS)
    total: np.ndarray = field(default_factory=lambda: _NO_COUNTS)
    back: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def of(cls, context: np.ndarray, total: np.ndarray) -> Hot:
        order = np.argsort(context)
        parts = np.maximum(1, np.ceil(np.log2(total[order] / HOT)))
        return cls(context[order], parts.astype(U), total[order], np.zeros(len(order)))

    def find(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which contexts are dealt, and the places of those."""
        if not len(self.context):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
        some = np.flatnonzero(self.context[at] == context)
        return some, at[some]

    def deal(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Contexts as shards know them."""
        some, at = self.find(context)
        out = mix(context + _ODD)
        out[some] = self._part(self.context[at], word[some] >> (U(64) - self.bits[at]))
        return out

    @staticmethod
    def _part(context: np.ndarray, part: np.ndarray) -> np.ndarray:
        return mix(mix(context + _ODD) + (part + U(1)) * _ODD)

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """All parts, and the place of the context that each belongs to."""
        many = (U(1) << self.bits).astype(np.int64)
        owner = np.repeat(np.arange(len(many)), many)
        return self._part(self.context[owner], (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)).astype(U)), owner


def _shard_of(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)


def _context_key(dealt: np.ndarray, bits: int) -> np.ndarray:
    return (dealt << U(bits)) >> U(64 - CONTEXT)


def _keys(dealt: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    return (_context_key(dealt, bits) << U(WORD)) | (word & U((1 << WORD) - 1))


def _sum_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _squeeze(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, and counts, byte plane by byte plane."""
    steps = np.diff(keys, prepend=U(0))
    planes = np.concatenate([steps.view(np.uint8).reshape(-1, 8).T.ravel(), counts.astype(U).view(np.uint8).reshape(-1, 8).T.ravel()])
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unsqueeze(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(2, 8, -1)
    keys, counts = (np.ascontiguousarray(p.T).view(U).ravel() for p in planes)
    return np.cumsum(keys, dtype=U), counts.astype(np.int64)


_SENT = "shard int, grams binary"


def _count(level: int, bits: int, hot: Hot, words: Hot | None):
    """Counts of a level's n-grams, for their shards; of pairs of tokens that are hot by themselves also for the side tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {"shard": [], "key": [], "side": []}

        def send() -> pa.RecordBatch:
            shards, blobs = [], []
            if held["key"]:
                shard, key = np.concatenate(held["shard"]), np.concatenate(held["key"])
                by = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[by], np.arange((1 << bits) + 1))
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    some = key[by[cuts[s] : cuts[s + 1]]]
                    shards.append(s)
                    blobs.append(_squeeze(*_sum_up(some, np.ones(len(some), np.int64))))
            if held["side"]:
                key, n = np.unique(np.concatenate(held["side"]), return_counts=True)
                for s in range(SIDE):
                    mine = (key % U(SIDE)).astype(np.int64) == s
                    if mine.any():
                        shards.append((1 << bits) + s)
                        blobs.append(_squeeze(key[mine], n[mine]))
            for x in held.values():
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "grams"])

        size = 0
        for batch in batches:
            for part in slices(batch):
                tokens, bounds = _tokens(part)
                if level == 1:
                    held["shard"].append(_shard_of(tokens, bits).astype(np.int16 if bits < 15 else np.int32))
                    held["key"].append(tokens)
                else:
                    before, has = contexts(tokens, bounds, level)
                    before, word = before[has], tokens[has]
                    dealt = hot.deal(before, word)
                    held["shard"].append(_shard_of(dealt, bits).astype(np.int16 if bits < 15 else np.int32))
                    held["key"].append(_keys(dealt, word, bits))
                    if words is not None and len(words.context):  # contexts of the next level
                        after, has = contexts(tokens, bounds, level + 1)
                        first = contexts(tokens, bounds, 2)[0]
                        both = np.zeros(len(tokens), bool)
                        both[words.find(first)[0]] = True
                        if level + 1 > 2:
                            second = np.full(len(tokens), START, U)
                            second[1:] = first[:-1]
                            other = np.zeros(len(tokens), bool)
                            other[words.find(second)[0]] = True
                            both &= other & has
                        held["side"].append(after[both])
                size += len(tokens)
                if size >= FLUSH:
                    size = 0
                    yield send()
        yield send()

    return run


_BUILT = "shard int, path string, distinct long, total long, contexts array<long>, counts array<long>"


def _received(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each shard of a task with all its keys and counts; sums up whenever twice ``SHARD`` keys are waiting."""
    held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
    for batch in batches:
        for shard, raw in zip(batch.column("shard").to_pylist(), batch.column("grams").to_pylist(), strict=True):
            keys, counts = held.setdefault(shard, ([], []))
            k, n = _unsqueeze(raw)
            keys.append(k)
            counts.append(n)
            if sum(map(len, keys)) > 2 * SHARD and len(keys) > 8:
                k, n = _sum_up(np.concatenate(keys), np.concatenate(counts))
                held[shard] = [k], [n]
    for shard in sorted(held):
        keys, counts = held.pop(shard)
        yield shard, *_sum_up(np.concatenate(keys), np.concatenate(counts))


def _row(shard: int, path: str, distinct: int, total: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    lists = [pa.array([x.view(np.int64).tolist()], pa.list_(pa.int64())) for x in (keys, counts)]
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([distinct]), pa.array([total]), *lists], [f.split()[0] for f in _BUILT.split(", ")])


def _build(folder: str, level: int, bits: int, hot: Hot):
    """Files of the shards; for side tasks, and for dealt contexts (their seen successors), rows to the driver."""

    def tokens(shard: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        universe = 1 << (64 - bits)
        total = np.concatenate([[0], np.cumsum(counts)])
        path = f"{folder}/1-{shard}-{uuid.uuid4().hex}.ef"
        save(path, EliasFano.build(keys & U(universe - 1), universe).arrays("key") | EliasFano.build(total, int(total[-1]) + 1).arrays("sum"))
        often = counts > HOT
        return _row(shard, path, len(keys), int(total[-1]), keys[often], counts[often])

    def grams(shard: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        context = keys >> U(WORD)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        pointer = np.append(first, len(keys))
        many = np.diff(pointer)
        owner = np.repeat(np.arange(len(first)), many)
        total = np.add.reduceat(counts, first)
        parts, of = hot.parts()
        mine = _shard_of(parts, bits) == shard
        part_key, of = _context_key(parts[mine], bits), of[mine]
        at = np.searchsorted(context[first], part_key)
        hit = (at < len(first)) & (context[first][np.minimum(at, len(first) - 1)] == part_key)
        total[at[hit]] = hot.total[of[hit]]
        share = (counts - DISCOUNT) / total[owner]
        left = DISCOUNT * many / total
        code = lambda x, step: np.clip(np.round(-np.log10(x) * step), 0, 255).astype(np.uint8)
        n = len(first)
        arrays = EliasFano.build(context[first], 1 << CONTEXT).arrays("context") | EliasFano.build(pointer, len(keys) + 1).arrays("pointer")
        arrays |= EliasFano.build((owner.astype(U) << U(WORD)) | (keys & U((1 << WORD) - 1)), n << WORD).arrays("next")
        path = f"{folder}/{level}-{shard}-{uuid.uuid4().hex}.ef"
        save(path, arrays | {"p": code(share, P_STEP), "b": code(left, B_STEP)})
        return _row(shard, path, len(keys), int(counts.sum()), hot.context[of[hit]], many[at[hit]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in _received(batches):
            if shard >= 1 << bits:
                often = counts > HOT
                yield _row(-1, "", 0, 0, keys[often], counts[often])
            elif level == 1:
                yield tokens(shard, keys, counts)
            elif len(keys):
                yield grams(shard, keys, counts)

    return run


# --- the trie -----------------------------------------------------------------------------------


@dataclass
class Level:
    bits: int
    paths: dict[int, str]
    hot: Hot


class Trie:
    """The levels; shards are mapped when they are needed."""

    def __init__(self) -> None:
        self.levels: list[Level] = []
        self.total = self.distinct = 0
        self._open: dict[str, tuple[dict, int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    def _mapped(self, path: str, *names: str) -> dict:
        if path in self._open:
            self._open[path] = self._open.pop(path)
        else:
            arrays = load(path)
            self._open[path] = ({n: EliasFano.load(arrays, n) for n in names} | {k: v for k, v in arrays.items() if k in ("p", "b")}, size_of(arrays))
            while len(self._open) > 1 and sum(n for _, n in self._open.values()) > (MAPPED if mounted(path) else READ):
                del self._open[next(iter(self._open))]
        return self._open[path][0]

    @staticmethod
    def _by_shard(level: Level, at: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        """Each shard's path and the places, in order of the hashes and some thousand at a time, of those that belong to it."""
        order = np.argsort(at)
        cuts = np.searchsorted(_shard_of(at[order], level.bits), np.arange((1 << level.bits) + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            if s in level.paths:
                for i in range(cuts[s], cuts[s + 1], PIECE):
                    yield level.paths[s], order[i : min(i + PIECE, cuts[s + 1])]

    def counts(self, tokens: np.ndarray) -> np.ndarray:
        """Exact training counts."""
        out = np.zeros(len(tokens), np.int64)
        level = self.levels[0]
        for path, some in self._by_shard(level, tokens):
            ef = self._mapped(path, "key", "sum")
            at = ef["key"].find(tokens[some] & U((1 << (64 - level.bits)) - 1))
            some, at = some[at >= 0], at[at >= 0]
            out[some] = (ef["sum"].access(at + 1) - ef["sum"].access(at)).astype(np.int64)
        return out

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADD) / (self.total + ADD * (self.distinct + 1))

    def seen(self, n: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of n-grams (0: never seen) and the weights their contexts leave to the level below (1: context never seen)."""
        level = self.levels[n - 1]
        share, left = np.zeros(len(word)), np.ones(len(word))
        dealt = level.hot.deal(context, word)
        for path, some in self._by_shard(level, dealt):
            ef = self._mapped(path, "context", "pointer", "next")
            key = _context_key(dealt[some], level.bits)  # in order
            new = np.concatenate([[True], key[1:] != key[:-1]])
            place = ef["context"].find(key[new])
            known = np.flatnonzero(place >= 0)
            lo, hi = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            lo[known], hi[known] = (ef["pointer"].access(place[known] + k).astype(np.int64) for k in (0, 1))
            at = np.cumsum(new) - 1
            ok = place[at] >= 0
            some, at = some[ok], at[ok]
            left[some] = _OF_B[ef["b"][place[at]]]
            got = ef["next"].find((place[at].astype(U) << U(WORD)) | (word[some] & U((1 << WORD) - 1)), lo[at], hi[at])
            hit = got >= 0
            share[some[hit]] = _OF_P[ef["p"][got[hit]]]
        some, at = level.hot.find(context)
        left[some] = 10 ** level.hot.back[at]
        return share, left

    def score(self, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Training count, log10 base and log10 model probability of each token."""
        distinct, at = np.unique(tokens, return_inverse=True)
        counts = self.counts(distinct)
        base = self.unigram(counts)
        p = base[at]
        for n in range(2, len(self.levels) + 1):
            before, has = contexts(tokens, bounds, n)
            place = np.flatnonzero(has)
            share, left = self.seen(n, before[place], tokens[place])
            p[place] = share + left * p[place]
        return counts[at], np.log10(base)[at], np.log10(p)


def _score(trie: Trie):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SCORED_BYTES):
                tokens, bounds = _tokens(part)
                counts, base, whole = trie.score(tokens, bounds)
                sums = lambda x: np.add.reduceat(x, bounds[:-1]) if part.num_rows else x[:0]
                keep = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(np.diff(bounds)), pa.array(sums((counts > 0).astype(np.int64))), pa.array(np.full(part.num_rows, trie.total)), pa.array(sums(base)), pa.array(sums(whole))],
                    [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def build_trie(spark: SparkSession, train: DataFrame, order: int = ORDER) -> Trie:
    """``train(text)`` -> the trie, its levels written to the shared folder."""
    scratch = Scratch(spark)
    folder = new_path(spark, "trie")
    system, place = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(place)
    trie = Trie()
    texts = train.select("text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    hot, words = Hot(), Hot()
    for n in range(1, order + 1):
        bits = int(size // SHARD_BYTES if n == 1 else trie.total // SHARD).bit_length()
        sent = texts.mapInArrow(_count(n, bits, hot, words if 1 < n < order else None), _SENT)
        built = sent.repartitionById((1 << bits) + SIDE, "shard").mapInArrow(_build(folder, n, bits, hot), _BUILT)
        built = scratch.keep(built, f"level-{n}")
        rows = built.collect()  # one for each shard and side task
        scratch.drop(built)
        found = [(r["contexts"], r["counts"]) for r in rows if (r["shard"] < 0) == (n > 1)]
        listed = np.array([c for x, _ in found for c in x], np.int64).view(U), np.array([c for _, x in found for c in x], np.int64)
        if n > 1:
            seen = [(r["contexts"], r["counts"]) for r in rows if r["shard"] >= 0]
            many = np.zeros(len(hot.context))
            if len(hot.context):
                np.add.at(many, np.searchsorted(hot.context, np.array([c for x, _ in seen for c in x], np.int64).view(U)), np.array([c for _, x in seen for c in x], np.int64))
                hot.back = np.log10(DISCOUNT * np.maximum(many, 1) / hot.total)
        trie.levels.append(Level(bits, {r["shard"]: r["path"] for r in rows if r["shard"] >= 0}, hot if n > 1 else Hot()))
        if n == 1:
            trie.total, trie.distinct = sum(r["total"] for r in rows), sum(r["distinct"] for r in rows)
            context, total = listed
            ends = context == END  # the end is never followed; a text starts as often as it ends
            context = np.where(ends, U(START), context)
            words = Hot.of(context, total)
            hot = words
        else:
            hot = Hot.of(*listed)
    return trie


def lm_score(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    remainder = F.expr(f"crc32(cast(doc_id as string)) % {FOLDS}")
    trie = build_trie(spark, rows.where(remainder != HELD), order)
    rows = rows.select("doc_id", F.coalesce(remainder == HELD, F.lit(False)).alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_score(trie), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
