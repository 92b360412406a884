"""Tokens and words with offsets, spans met with tokens, and digests.

Texts are opened in Arrow batches: Python's pattern engine finds pieces with
their offsets in one pass, where SQL needs a partition of the text, an explode
and two windows (measured on 25 MB: 12 s on eight cores, against 2 s).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"\w+|[^\w\s]")
#: From the first to the last letter or digit of a run without white space.
WORD = re.compile(r"[^\W_](?:[^ \t\n\x0b\f\r]*[^\W_])?")


#: Bytes of rows opened at once, about: pieces take a hundred times the room of their text, and a batch holds what 10,000 documents have.
HELD = 1 << 19


def runs(batch: pa.RecordBatch, weight: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A batch's rows in runs of about ``HELD`` bytes of ``text`` (or of another ``weight`` of each row); a heavier row is a run of its own."""
    if weight is None:
        weight = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(weight.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + HELD, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _found(pattern: re.Pattern, text: str) -> np.ndarray:
    spans = [m.span() for m in pattern.finditer(text)]
    return np.array(spans, np.int32).reshape(-1, 2)


def _opened(pattern: re.Pattern, ahead: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in runs(whole)):
            texts = batch.column("text").to_pylist()
            at, toks, many = [], [], []
            for text in texts:
                spans = [m.span() for m in pattern.finditer(text or "")]
                at += spans
                toks += [text[a:b] for a, b in spans]
                many.append(len(spans))
            place, count = np.array(at, np.int32).reshape(-1, 2), np.array(many, np.int64)
            first = np.cumsum(count) - count
            row = pa.array(np.repeat(np.arange(len(texts)), count))
            ids, tok = batch.column("doc_id").take(row), pa.array(toks, pa.string())
            arrays = [ids, pa.array((np.arange(len(at)) - np.repeat(first, count)).astype(np.int32)), pa.array(place[:, 0]), pa.array(place[:, 1]), tok]
            names = ["doc_id", "ord", "start", "end", "tok"]
            if ahead:
                follows = np.arange(1, len(at) + 1)
                last = np.zeros(len(at), bool)
                last[(first + count - 1)[count > 0]] = True
                after = pa.array(np.where(last, 0, follows), mask=last)
                arrays += [arrays[2].take(after), arrays[3].take(after), tok.take(after)]
                names += ["start2", "end2", "tok2"]
            for i in range(0, len(at), 1 << 16):
                yield pa.RecordBatch.from_arrays(arrays, names).slice(i, 1 << 16)

    return run


def _open(docs: DataFrame, pattern: re.Pattern, ahead: bool = False) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", start2 int, end2 int, tok2 string" if ahead else ""
    return docs.select("doc_id", "text").mapInArrow(_opened(pattern, ahead), f"doc_id {kind}, ord int, start int, end int, tok string{more}")


def tokens(docs: DataFrame) -> DataFrame:
    """``doc_id, ord, start, end, tok``: words and single symbols, white space left out."""
    return _open(docs, TOKEN)


def words(docs: DataFrame, ahead: bool = False) -> DataFrame:
    """``doc_id, ord, start, end, word``: white-space chunks without outer punctuation, chunks of punctuation left out; ``ahead`` adds the next word's ``start2, end2, word2``."""
    return _open(docs, WORD, ahead).withColumnsRenamed({"tok": "word", "tok2": "word2"})


def weighed(batch: pa.RecordBatch, listed: str, text: str | None = "text") -> np.ndarray:
    """Bytes of a row's text (if any), and 64 for each entry of a list beside it."""
    size = lambda x: pc.fill_null(x, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = 64 * size(pc.list_value_length(batch.column(listed)))
    return entries if text is None else entries + size(pc.binary_length(batch.column(text)))


def _meet(payload: list[str], every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in runs(whole, weighed(whole, "spans_"))):
            texts, lists = batch.column("text").to_pylist(), batch.column("spans_")
            flat, offsets = lists.flatten(), np.concatenate([[0], np.cumsum(np.array(lists.value_lengths().fill_null(0)))])
            begin, end = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
            docs, ords, starts, ends, hits, counts = [], [], [], [], [], []
            for i, text in enumerate(texts):
                a, b = offsets[i], offsets[i + 1]
                if a == b and not every:
                    continue
                place = _found(TOKEN, text or "")
                lo, hi = np.searchsorted(place[:, 1], begin[a:b], "right"), np.searchsorted(place[:, 0], end[a:b], "left")
                size = np.maximum(hi - lo, 0)
                span = np.repeat(np.arange(a, b), size)
                token = np.repeat(lo, size) + np.arange(len(span)) - np.repeat(np.cumsum(size) - size, size)
                by = np.argsort(token, kind="stable")
                per = np.bincount(token, minlength=len(place))
                keep = np.arange(len(place)) if every else np.flatnonzero(per)
                docs.append(np.full(len(keep), i))
                ords.append(keep)
                starts.append(place[keep, 0])
                ends.append(place[keep, 1])
                hits.append(span[by])
                counts.append(per[keep])
            if not docs:
                continue
            join = lambda x, kind: pa.array(np.concatenate(x).astype(kind))
            taken = flat.take(join(hits, np.int64))
            held = pa.StructArray.from_arrays([taken.field(c) for c in payload], payload)
            rows = [batch.column("doc_id").take(join(docs, np.int64)), join(ords, np.int32), join(starts, np.int32), join(ends, np.int32)]
            rows.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)), held))
            whole = pa.RecordBatch.from_arrays(rows, ["doc_id", "ord", "start", "end", "hits"])
            for i in range(0, whole.num_rows, 1 << 16):
                yield whole.slice(i, 1 << 16)

    return run


def met(docs: DataFrame, spans: DataFrame, every: bool = False) -> DataFrame:
    """Tokens met with the spans that overlap them: ``doc_id, ord, start, end, hits``.

    ``hits`` lists the spans (their columns, ``doc_id`` aside) in the order of
    those columns.  Tokens without a span are left out unless ``every``.  The
    spans of a document travel to its text, and sorted offsets find each span's
    run of tokens: no token is joined with all spans of its document.
    """
    payload = [c for c in spans.columns if c != "doc_id"]
    listed = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in payload)))).alias("spans_"))
    rows = docs.select("doc_id", "text").join(listed, "doc_id", "left" if every else "inner")
    held = T.StructType([T.StructField(c, spans.schema[c].dataType) for c in payload])
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.IntegerType()) for c in ("ord", "start", "end")), T.StructField("hits", T.ArrayType(held))])
    return rows.mapInArrow(_meet(payload, every), schema)


def digest16(column: str) -> str:
    """First sixteen hex digits of a text's SHA-256."""
    return f"substring(sha2({column}, 256), 1, 16)"
