"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes, white space included, are read whole: in pieces of
``PIECE`` bytes, each with ``AROUND`` bytes of its neighbours on either side, so
that states are warm at a piece's first and last byte.  One GRU reads a piece
forwards, one backwards; from both states a softmax labels every byte with a
language, or with a last class for scrambled text, so that letters in no
language's order score low.  A document's probabilities are the mean over all
its bytes.

The network is trained in numpy by backpropagation through time with Adam, on
``WINDOWS`` windows of ``WINDOW`` characters, at hashed places of the whole
text, of about ``PER_LANGUAGE`` labelled documents of each language (chosen by
hashed id, ``MOST`` times that at most).  Language, source and id are never
inputs.

``accepted`` rejects texts that score lower than all but ``REJECTED`` of held-out
documents of known language do, so the bar follows the model and the number of
languages.  Every such document is scored for the bar, which is their exact
quantile.

Cases: null text, or text without a letter, is ``und`` with score 0; texts are
read whole; a null id is not held out and not learned from; repeated rows are
labelled each; without any labelled text every document is ``und``; a language
column of any type is read as text; only the id, text and language columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Scratch, free_prefix
from ._words import slices

PER_LANGUAGE, MOST, WINDOWS, WINDOW = 300, 4, 8, 160
HIDDEN, PIECE, AROUND, ROWS = 12, 224, 16, 1024
STEPS, BATCH, SEQUENCE, RATE = 250, 192, 64, 0.02
UNKNOWN = "und"
#: Share of rightly labelled held-out documents that may score too low for ``accepted``.
REJECTED = 0.001
#: Bins of a round that narrows down a quantile.
BINS = 4096
#: Documents whose remainder is this one are held out.
FOLDS, HELD = 4, 2

Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def init(languages: int, hidden: int = HIDDEN, seed: int = 7, kind: type = np.float32) -> Params:
    rng = np.random.default_rng(seed)
    p: Params = {}
    for way in "fb":
        p["x" + way] = rng.normal(0, 0.3, (256, 3 * hidden))  # a byte's share of update, reset and candidate
        p["u" + way] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))
        p["n" + way] = np.zeros(hidden)
    p["w"], p["b"] = rng.normal(0, 0.1, (2 * hidden, languages)), np.zeros(languages)
    return {k: v.astype(kind) for k, v in p.items()}


def _run(p: Params, way: str, seq: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each byte of ``seq`` (steps, rows); for training also what the way back needs."""
    x, u, bias = p["x" + way], p["u" + way], p["n" + way]
    size = u.shape[0]
    h = np.zeros((seq.shape[1], size), x.dtype)
    out = np.empty((len(seq), seq.shape[1], size), x.dtype)
    for t, code in enumerate(seq):
        a, g = x[code], h @ u
        gates = _sigmoid(a[:, : 2 * size] + g[:, : 2 * size])
        z, r = gates[:, :size], gates[:, size:]
        m = g[:, 2 * size :] + bias
        n = np.tanh(a[:, 2 * size :] + r * m)
        if keep is not None:
            keep.append((h, z, r, m, n))
        h = n + z * (h - n)
        out[t] = h
    return out


def _back(p: Params, way: str, seq: np.ndarray, kept: list, dout: np.ndarray, grad: Params) -> None:
    u = p["u" + way]
    size = u.shape[0]
    du, dn = np.zeros_like(u), np.zeros_like(p["n" + way])
    das = np.empty((*seq.shape, 3 * size), u.dtype)
    dh = np.zeros_like(dout[0])
    for t in range(len(seq) - 1, -1, -1):
        h, z, r, m, n = kept[t]
        dh = dh + dout[t]
        dcand = dh * (1 - z) * (1 - n * n)
        dm = dcand * r
        da = np.concatenate([dh * (h - n) * z * (1 - z), dcand * m * r * (1 - r), dcand], axis=1)
        dg = np.concatenate([da[:, : 2 * size], dm], axis=1)
        das[t] = da
        du += h.T @ dg
        dn += dm.sum(axis=0)
        dh = dh * z + dg @ u.T
    codes, das = seq.ravel(), das.reshape(-1, 3 * size)
    dx = np.stack([np.bincount(codes, das[:, j], 256) for j in range(3 * size)], axis=1).astype(u.dtype)
    grad["x" + way], grad["u" + way], grad["n" + way] = dx, du, dn


def _states(p: Params, seq: np.ndarray, kept: tuple[list, list] | None = None) -> np.ndarray:
    ahead = _run(p, "f", seq, kept[0] if kept else None)
    behind = _run(p, "b", seq[::-1], kept[1] if kept else None)[::-1]
    return np.concatenate([ahead, behind], axis=2)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def loss_and_gradient(p: Params, sequences: np.ndarray, truth: np.ndarray) -> tuple[float, Params]:
    """Mean cross-entropy of all bytes of ``sequences`` (rows, bytes), and its gradient through time."""
    seq, kept = sequences.T, ([], [])
    state = _states(p, seq, kept)
    prob = _softmax(state @ p["w"] + p["b"])
    row = np.arange(len(truth))
    loss = -np.log(prob[:, row, truth] + 1e-12).mean()
    prob[:, row, truth] -= 1
    dlogit = prob / (len(seq) * len(row))
    size = p["uf"].shape[0]
    grad: Params = {"w": np.tensordot(state, dlogit, ((0, 1), (0, 1))), "b": dlogit.sum(axis=(0, 1))}
    dstate = dlogit @ p["w"].T
    _back(p, "f", seq, kept[0], dstate[:, :, :size], grad)
    _back(p, "b", seq[::-1], kept[1], dstate[::-1, :, size:], grad)
    return float(loss), grad


def train(windows: list[tuple[bytes, int]], languages: int, steps: int | None = None, seed: int = 7) -> Params:
    """``windows``: (bytes, language); every step reads ``BATCH`` sequences of ``SEQUENCE`` bytes, as many of each language, from places drawn evenly."""
    by = [b" ".join(w for w, t in windows if t == k) for k in range(languages)]
    codes = [np.frombuffer(x + b" " * max(0, SEQUENCE - len(x)), np.uint8) for x in by]
    rng, p, steps = np.random.default_rng(seed), init(languages, seed=seed), steps or STEPS
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    truth = np.arange(BATCH) % languages
    for step in range(1, steps + 1):
        at = [int(rng.integers(0, len(codes[t]) - SEQUENCE + 1)) for t in truth]
        _, grad = loss_and_gradient(p, np.stack([codes[t][i : i + SEQUENCE] for t, i in zip(truth, at, strict=True)]), truth)
        rate = RATE * (1 - 0.9 * step / steps)
        for k, g in grad.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(p[k].dtype)
    return p


def _labelled(docs: DataFrame, held: bool) -> DataFrame:
    """Labelled documents with a text; held-out rows only, or none of them."""
    remainder = F.expr(f"crc32(cast(doc_id as string)) % {FOLDS}")
    return docs.where(((remainder == HELD) if held else (remainder != HELD)) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def _chosen(docs: DataFrame, per_language: int) -> tuple[DataFrame, int] | None:
    """``lang, text, at`` of about ``per_language`` labelled documents of each language, by hashed id, and a bound on their number; none held out."""
    usable = _labelled(docs, False)
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    ids = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    bound = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1 << 30, -(-(per_language << 30) // n)))))
    chosen = usable.where(ids < bound[F.col("lang")]).select("lang", "text", ids.alias("at"), F.xxhash64("text").alias("mark"))
    return chosen.orderBy("at", "lang", "mark"), MOST * per_language * len(counts)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """(language, window of text) pairs of labelled documents that are not held out."""
    chosen = _chosen(docs, per_language)
    if chosen is None:
        return []
    place = f"1 + pmod(xxhash64(at, i), greatest(length(text) - {WINDOW} + 1, 1))"
    windows = f"transform(sequence(0, least({WINDOWS - 1}, length(text) div {WINDOW})), i -> substring(text, cast({place} as int), {WINDOW}))"
    rows = chosen[0].select("lang", "at", "mark", F.expr(windows).alias("w")).limit(chosen[1]).collect()
    return [(r["lang"], w) for r in sorted(rows, key=lambda r: (r["at"], r["lang"], r["mark"])) for w in r["w"] if w]


def scrambled(windows: list[str], seed: int = 5) -> list[str]:
    """The last class, no language: windows with their characters in another order, or drawn evenly from all characters that occur."""
    rng = np.random.default_rng(seed)
    every = sorted(set("".join(windows)))
    out = []
    for n, w in enumerate(windows):
        if n % 2:
            out.append("".join(w[i] for i in rng.permutation(len(w))))
        else:
            drawn = "".join(every[i] for i in rng.integers(0, len(every), len(w)))
            out.append("".join(d if c != " " else c for c, d in zip(w, drawn, strict=True)))
    return out


def fit(pairs: list[tuple[str, str]]) -> tuple[list[str], Params]:
    """Languages by name, and the network: a class for each, and one for scrambled text."""
    names = sorted({lang for lang, _ in pairs})
    if not names:
        return names, init(0)
    noise = scrambled([w for _, w in pairs])
    return names, train([(w.encode(), names.index(lang)) for lang, w in pairs] + [(w.encode(), len(names)) for w in noise], len(names) + 1)


class Labeller:
    """The trained network, both ways in one pass over many pieces."""

    def __init__(self, p: Params):
        size = p["uf"].shape[0]
        self.size, self.languages = size, len(p["b"])
        # sigmoid(x) = (1 + tanh(x / 2)) / 2: the halves go into the weights of the gates
        x, u = np.concatenate([p["xf"], p["xb"]]).astype(np.float32), np.stack([p["uf"], p["ub"]]).astype(np.float32)
        self.gate_x, self.new_x = x[:, : 2 * size] / 2, x[:, 2 * size :].copy()
        self.gate_u, self.new_u = u[:, :, : 2 * size] / 2, u[:, :, 2 * size :].copy()
        self.n = np.stack([p["nf"], p["nb"]]).astype(np.float32)[:, None, :]
        self.w, self.b = np.stack([p["w"][:size], p["w"][size:]]).astype(np.float32), p["b"].astype(np.float32)

    def labels(self, codes: np.ndarray) -> np.ndarray:
        """Language probabilities of every byte of equally long pieces: (rows, bytes) -> (bytes, rows, languages)."""
        rows, steps = codes.shape
        size = self.size
        both = np.empty((steps, 2, rows), np.int64)
        both[:, 0], both[:, 1] = codes.T, codes.T[::-1].astype(np.int64) + 256
        logit = np.empty((steps, 2, rows, self.languages), np.float32)
        h, gate, more = np.zeros((2, rows, size), np.float32), *(np.empty((2, rows, 2 * size), np.float32) for _ in range(2))
        new, other = (np.empty((2, rows, size), np.float32) for _ in range(2))
        for t in range(steps):
            np.take(self.gate_x, both[t], axis=0, out=gate, mode="clip")
            np.take(self.new_x, both[t], axis=0, out=other, mode="clip")
            np.matmul(h, self.gate_u, out=more)
            np.matmul(h, self.new_u, out=new)
            gate += more
            np.tanh(gate, out=gate)
            gate += 1
            gate *= 0.5
            new += self.n
            new *= gate[:, :, size:]
            new += other
            np.tanh(new, out=new)
            h -= new
            h *= gate[:, :, :size]
            h += new
            np.matmul(h, self.w, out=logit[t])
        out = logit[:, 0]
        out += logit[::-1, 1]
        out += self.b
        out -= out.max(axis=-1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=-1, keepdims=True)
        return out

    def texts(self, text: pa.Array) -> np.ndarray:
        """Sums over all bytes of each text, one column for each language."""
        data = text.cast(pa.binary())
        at = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, data.offset * 4).astype(np.int64) if len(data) else np.zeros(1, np.int64)
        raw = np.frombuffer(data.buffers()[2], np.uint8) if len(data) and data.buffers()[2] else np.zeros(0, np.uint8)
        many = -(-np.diff(at) // PIECE)
        owner = np.repeat(np.arange(len(data)), many)
        start = at[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * PIECE
        out = np.zeros((len(data), self.languages))
        step = np.arange(-AROUND, PIECE + AROUND)
        for i in range(0, len(owner), ROWS):
            of, begin = owner[i : i + ROWS], start[i : i + ROWS]
            place = begin[:, None] + step
            inside = (place >= at[of][:, None]) & (place < at[of + 1][:, None])
            codes = np.where(inside, raw[np.clip(place, 0, max(len(raw) - 1, 0))], 32)
            prob = self.labels(codes)[AROUND:-AROUND]
            prob *= inside.T[AROUND:-AROUND, :, None]
            np.add.at(out, of, prob.sum(axis=0))
        return out


_labellers: dict[bytes, Labeller] = {}


def _predict(names: list[str], p: Params, own: str, with_text: bool = False):
    key = b"".join(v.tobytes() for _, v in sorted(p.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _labellers:
            _labellers.clear()
            _labellers[key] = Labeller(p)
        labeller = _labellers[key]
        for batch in batches:
            for part in slices(batch):
                text = pc.fill_null(part.column("text"), "")
                sums = labeller.texts(text)
                prob = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-9)
                best = prob[:, : len(names)].argmax(axis=1)
                letter = pc.match_substring_regex(text, r"\pL").to_numpy(zero_copy_only=False)
                pred = [names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letter.tolist(), strict=True)]
                score = np.where(letter, np.minimum(prob[np.arange(len(best)), best], 1.0), 0.0)
                keep = [c for c in batch.schema.names if with_text or c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score)], [*keep, own + "lang", own + "score"])

    return run


def identify_language(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: tuple[list[str], Params] | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, lang_pred, score``; trains on ``docs`` unless given a model."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    held = F.coalesce(F.expr(f"crc32(cast(doc_id as string)) % {FOLDS} = {HELD}"), F.lit(False)).alias("held_out")
    names, p = model or fit(sample(rows))
    rows = rows.select("doc_id", held, "text")
    if not names:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    out = rows.mapInArrow(_predict(names, p, "__"), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, __lang string, __score double")
    return out.withColumnsRenamed({"__lang": "lang_pred", "__score": "score"})


def at_rank(scores: DataFrame, rank: int) -> float:
    """The value of ``score`` with this rank (from 0), exactly: rounds of counts in bins of the interval it lies in; at most ``BINS + 1`` rows reach the driver."""
    score = F.col("score")
    low, high = scores.agg(F.min(score), F.max(score)).first()
    while low < high:  # least and greatest value fall in different bins, so every round narrows the interval
        bins = scores.where(score.between(low, high)).groupBy(F.floor((score - low) / (high - low) * BINS).alias("bin"))
        for _, n, low, high in sorted(bins.agg(F.count(F.lit(1)), F.min(score), F.max(score)).collect()):
            if rank < n:
                break
            rank -= n
    return low


def least_score(docs: DataFrame, names: list[str], p: Params, share: float = REJECTED) -> float:
    """The score that all but ``share`` of the rightly labelled held-out documents reach, from all of them and their whole texts (training documents where none held out is rightly labelled)."""
    scratch = Scratch(docs.sparkSession)
    for held in (True, False):
        scored = _labelled(docs, held).select("lang", "text").mapInArrow(_predict(names, p, "__"), "lang string, __lang string, __score double")
        scores = scratch.keep(scored.where("lang = __lang").select(F.col("__score").alias("score")), "scores")
        n = scores.count()
        least = at_rank(scores, int(share * n)) if n else None
        scratch.drop(scores)
        if least is not None:
            return least
    return 0.0


def accepted(docs: DataFrame, least: float | None = None) -> DataFrame:
    """The rows of ``docs(doc_id, text, lang, ...)`` that get a language with at least this score (``least_score`` unless given), all columns; null languages are filled in.

    Texts without a letter are not kept.  Where no row has a language there is
    nothing to learn from, and every row with a letter stays.
    """
    labelled = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    names, p = fit(sample(labelled))
    if not names:
        return docs.where(r"text rlike '\\p{L}'")
    least = least_score(labelled, names, p) if least is None else least
    own = free_prefix(docs.columns)
    schema = T.StructType([*docs.schema, T.StructField(own + "lang", T.StringType()), T.StructField(own + "score", T.DoubleType())])
    out = docs.mapInArrow(_predict(names, p, own, True), schema).where((F.col(own + "lang") != UNKNOWN) & (F.col(own + "score") >= least))
    filled = F.coalesce("lang", F.col(own + "lang").cast(docs.schema["lang"].dataType)) if isinstance(docs.schema["lang"].dataType, T.StringType) else F.col("lang")
    return out.withColumn("lang", filled).drop(own + "lang", own + "score")
