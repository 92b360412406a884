"""Elias-Fano coded monotone sequences over flat arrays, searched by whole numpy batches.

A sequence of ``n`` values below ``universe`` keeps the low ``l`` bits of each
value packed, and the high parts in unary in a bit vector with a directory of
ones before each word.  All arrays may be views of a memory-mapped file.
"""

from __future__ import annotations

import json
import mmap
import os
from collections.abc import Mapping
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow.fs

U = np.uint64
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Place of the k-th set bit of a byte, at eight times the byte plus k.
_NTH = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[k] for b in range(256) for k in range(8)], np.uint8)
#: Every byte's lowest bit, and its highest.
_LOW, _HIGH = U(0x0101010101010101), U(0x8080808080808080)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` low bits of each value, end to end, in words (one spare word)."""
    out = np.zeros((len(values) * bits + 63) // 64 + 2, U)
    if bits and len(values):
        at = np.arange(len(values), dtype=U) * U(bits)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        np.bitwise_or.at(out, word, values << shift)
        np.bitwise_or.at(out, word + 1, (values >> (U(63) - shift)) >> U(1))
    return out


class EliasFano:
    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self._zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n, values = len(values), values.astype(U)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = _pack(values & U((1 << bits) - 1), bits)
        place = (values >> U(bits)).astype(np.int64) + np.arange(n)
        size = n + (max(universe - 1, 0) >> bits) + 2
        flags = np.zeros(-(-size // 64) * 64, np.uint8)
        flags[place] = 1
        high = np.packbits(flags, bitorder="little").view("<u8").astype(U)
        count = _ONES[high.view(np.uint8)].reshape(-1, 8).sum(axis=1, dtype=np.int64)
        return cls(n, bits, low, high, np.concatenate([[0], np.cumsum(count)]).astype(np.uint32 if size < 1 << 32 else np.int64))

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.head": np.array([self.n, self.bits], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones}

    @classmethod
    def load(cls, arrays: Mapping[str, np.ndarray], name: str) -> EliasFano:
        n, bits = arrays[f"{name}.head"].tolist()
        return cls(n, bits, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ones"])

    def _in_word(self, word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th set bit of each word, all bytes of a word at once."""
        k = k.astype(U)
        x = word - ((word >> U(1)) & U(0x5555555555555555))
        x = (x & U(0x3333333333333333)) + ((x >> U(2)) & U(0x3333333333333333))
        total = ((x + (x >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * _LOW  # each byte: ones up to it
        fits = (((k * _LOW) | _HIGH) - total) & _HIGH  # set where a byte's total is at most k
        bits = np.minimum(((fits >> U(7)) * _LOW) >> U(56), U(7)) << U(3)  # whole bytes before the bit, in bits
        rest = np.minimum(k - (((total << U(8)) >> bits) & U(255)), U(7))
        return (bits + _NTH[((((word >> bits) & U(255)) << U(3)) | rest).astype(np.int64)]).astype(np.int64)

    def _select1(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, k, "right") - 1
        return word * 64 + self._in_word(np.ascontiguousarray(self.high[word]), k - self.ones[word])

    def _select0(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self._zeros, k, "right") - 1
        return word * 64 + self._in_word(~self.high[word], k - self._zeros[word])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        at = i.astype(U) * U(self.bits)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        return ((self.low[word] >> shift) | (self.low[word + 1] << (U(63) - shift)) << U(1)) & U((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        return ((self._select1(i) - i).astype(U) << U(self.bits)) | self._low(i)

    def successor(self, q: np.ndarray, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """First place in ``[start, stop)`` whose value is at least ``q``, ``stop`` if there is none."""
        q = q.astype(U)
        part = (q >> U(self.bits)).astype(np.int64)
        lo = np.where(part > 0, self._select0(np.maximum(part - 1, 0)) - part + 1, 0)
        hi = self._select0(part) - part
        if start is not None:
            lo, hi = np.clip(lo, start, stop), np.clip(hi, start, stop)
        want = q & U((1 << self.bits) - 1)
        active = np.flatnonzero(lo < hi)
        while len(active):  # binary search among values of one high part
            mid = (lo[active] + hi[active]) >> 1
            less = self._low(mid) < want[active]
            lo[active[less]] = mid[less] + 1
            hi[active[~less]] = mid[~less]
            active = active[lo[active] < hi[active]]
        return lo

    def find(self, q: np.ndarray, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """Place of ``q`` in ``[start, stop)``, -1 where absent."""
        at = self.successor(q, start, stop)
        inside = at < (self.n if stop is None else stop)
        some = np.flatnonzero(inside)
        out = np.full(len(at), -1, np.int64)
        hit = some[self.access(at[some]) == q[some].astype(U)] if len(some) else some
        out[hit] = at[hit]
        return out


def save(path: str, arrays: Mapping[str, np.ndarray]) -> None:
    """One file: a line of JSON with name, type and place of every array, then the arrays, each at a multiple of eight."""
    system, place = pyarrow.fs.FileSystem.from_uri(path)
    head, at = {}, 0
    for k, v in arrays.items():
        head[k] = [v.dtype.str, len(v), at]
        at += -(-v.nbytes // 8) * 8
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 8) + b"\n"
    with system.open_output_stream(place) as f:
        f.write(line)
        for v in arrays.values():
            f.write(np.ascontiguousarray(v).tobytes() + bytes(-v.nbytes % 8))


def size_of(arrays: Mapping[str, np.ndarray]) -> int:
    return sum(v.nbytes for v in arrays.values())


def mounted(path: str) -> bool:
    return urlparse(path).scheme in ("", "file")


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays, memory-mapped where the folder is mounted, read otherwise."""
    where = urlparse(path)
    if mounted(path):
        with open(unquote(where.path), "rb") as f:
            raw = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)) if os.fstat(f.fileno()).st_size else memoryview(b"")
    else:
        system, place = pyarrow.fs.FileSystem.from_uri(path)
        with system.open_input_file(place) as f:
            raw = memoryview(f.read())
    end = bytes(raw[: 1 << 16]).index(b"\n") + 1
    return {k: np.frombuffer(raw, np.dtype(t), n, end + at) for k, (t, n, at) in json.loads(bytes(raw[:end])).items()}
