"""Token ids of whole texts, encoded once for each distinct word and gathered.

A tokenizer whose file has the normaliser and pre-tokenizer below drops white
space and never merges across it, so a text's ids are its words' ids in order.
New words are encoded by the tokenizers library: plain Latin texts piece by
piece through its BPE model, all others by whole words.  Texts for any other
tokenizer are encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._words import slices, split_words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

END_ID = 1
#: Texts of these characters only are lower-cased and cut into pieces without Unicode tables; the rest of the pattern finds special tokens.
_OTHER = r"[^\t-\r -~À-ÿ]|<\|"
_CUT = r"('(?:s|t|re|ve|m|ll|d)|[^\sa-z0-9ß-öø-ÿ]+|[0-9])"
# The steps before the model for which words can be encoded by themselves.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {
    "type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True,
}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Words (and pieces) whose ids a worker remembers; it then starts anew.
CACHED = 600_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for 256, 257 and so on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(rest)}


class _Memory:
    """Ids of recent words; starts anew when it holds ``CACHED`` of them."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}  # word -> its place in ``starts`` and ``sizes``
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def slots(self, words: list[str]) -> np.ndarray:
        if len(self.slot) > CACHED:
            self._clear()
        slot, encode = self.slot, self.encode
        new = [w for w in words if w not in slot]
        if new:
            for n, w in enumerate(new, len(slot)):
                slot[w] = n
            found = [encode(w) for w in new]
            sizes = np.array([len(x) for x in found], np.int64)
            pool = np.array(list(chain.from_iterable(found)), np.uint32)
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
            self.sizes, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, pool])
        return np.array([slot[w] for w in words], np.int64)


class WordEncoder:
    """Encodes batches of texts; keeps the ids of recent words and pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.by_words = words_stand_alone(self.whole)
        self.letters = _byte_letters()
        self.pieces, self.words = _Memory(self._piece), _Memory(self._whole_word)

    def _piece(self, piece: str) -> list[int]:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(letters)]

    def _whole_word(self, word: str) -> list[int]:
        return self.whole.encode(word, add_special_tokens=False).ids

    def _gather(self, memory: _Memory, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, bounds = split_words(text)
        coded = pc.dictionary_encode(words)
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        code = memory.slots(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        length = memory.sizes[code]
        ends = np.cumsum(length)
        ids = memory.pool[np.repeat(memory.starts[code] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[bounds]

    def encode(self, text: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts (null: empty), each followed by ``end_id``, and each text's first place."""
        text = pc.fill_null(text, "")
        if not self.by_words:
            found = [e.ids for e in self.whole.encode_batch(text.to_pylist(), add_special_tokens=False)]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
            return _closed(np.fromiter(chain.from_iterable(found), np.uint32, bounds[-1]), bounds, end_id)
        plain = pc.invert(pc.match_substring_regex(text, _OTHER))
        if pc.all(plain).as_py() is not False:
            ids, bounds = self._gather(self.pieces, pc.replace_substring_regex(pc.utf8_lower(text), _CUT, r" \1 "))
        else:
            some = plain.to_numpy(zero_copy_only=False)
            a, at = self._gather(self.pieces, pc.replace_substring_regex(pc.utf8_lower(text.filter(plain)), _CUT, r" \1 "))
            b, of = self._gather(self.words, text.filter(pc.invert(plain)))
            size, start = np.empty(len(text), np.int64), np.empty(len(text), np.int64)
            size[some], size[~some] = np.diff(at), np.diff(of)
            start[some], start[~some] = at[:-1], of[:-1] + len(a)
            bounds = np.concatenate([[0], np.cumsum(size)])
            ids = np.concatenate([a, b])[np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])]
        return _closed(ids, bounds, end_id)


def words_stand_alone(tokenizer) -> bool:
    """Whether the steps before the model are the ones above, and special tokens hold ``<|`` and no white space (so that the rule for plain texts finds them)."""
    file = json.loads(tokenizer.to_str())
    steps = file["pre_tokenizer"] or {}
    special = [t["content"] for t in file["added_tokens"]]
    return file["normalizer"] == _NORMALIZER and steps.get("pretokenizers") == [_SPLIT, _BYTES] and all("<|" in t and not any(map(str.isspace, t)) for t in special)


def _closed(ids: np.ndarray, bounds: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by ``end_id``, if there is one."""
    if end_id is None:
        return ids, bounds
    n = len(bounds) - 1
    out = np.empty(len(ids) + n, np.uint32)
    last = bounds[1:] + np.arange(n)
    keep = np.ones(len(out), bool)
    keep[last] = False
    out[keep], out[last] = ids, end_id
    return out, bounds + np.arange(n + 1)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None = END_ID) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in slices(batch):
            yield part, *encoder(path).encode(part.column("text"), end_id)
