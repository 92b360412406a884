"""Vectorised word splitting and rolling hashes over Arrow batches.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; null text has
no words.  Hashes are polynomials over 64-bit word hashes, modulo 2**64, so the
hash of any word span comes from two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about ``limit`` text bytes (a longer text comes alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, and each text's first word index (one more entry than texts)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    words, offsets = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
    filled = pc.greater(pc.binary_length(words), 0)
    keep = filled.to_numpy(zero_copy_only=False)
    if not keep.all():
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        words = words.filter(filled)
    return words, offsets.astype(np.int64)


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every word, from prefix sums over the words' bytes."""
    data = words.cast(pa.binary())
    bounds = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, data.offset * 4) if len(data) else np.zeros(1, np.int32)
    raw = np.frombuffer(data.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if len(data) and data.buffers()[2] else np.zeros(0, np.uint8)
    at = (bounds - bounds[0]).astype(np.int64)
    code = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return mix(Rolling(code[raw], 0xA0761D6478BD642F).span(at[:-1], at[1:]) + np.diff(at).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply, xor-shift)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Span hashes over one array of word hashes, for one odd base."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes)
        up, down = self._powers.get(base, (np.zeros(0, np.uint64),) * 2)
        if len(up) < n + 1:
            size = max(n + 1, 1 << 16) * 5 // 4
            inverse = pow(base, -1, 1 << 64)
            up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
            for x in (up, down):
                x[0] = 1
                np.cumprod(x, dtype=np.uint64, out=x)
            self._powers[base] = up, down
        self.down = down
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:n], dtype=np.uint64, out=self.sums[1:])

    def span(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])
