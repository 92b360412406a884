"""Chat formatting by columnar byte assembly.

A turn is written as ``<turn:ROLE>TEXT</turn>`` and a line feed.  Inside role
and text a backslash precedes every backslash, ``<`` and ``>``, so control
strings in a text are text, and reading back is exact.

For each batch of turns numpy computes the lengths of all segments, their
cumulative offsets, and scatter indices; headers and contents are copied into
one preallocated buffer that becomes the Arrow column.  The loss mask lists the
byte ranges of the assistant's texts as written.

Cases: null role or text is empty; rows are ordered by turn (null first), then
role and text; rows with a null conversation form one; repeated rows are
repeated turns; an empty table gives an empty one; a conversation becomes one
cell, so its text must be under 2 GB; only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, FOOT = b"<turn:", b">", b"</turn>\n"
LOSS_ROLE = "assistant"
#: Texts of whole conversations that are assembled at once; a longer one comes alone.
RUN_BYTES = 256 << 20
_TURN = re.compile(r"<turn:((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.)*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_ESCAPED_BYTES = re.compile(rb"\\(.)", re.S)


def escape(text: pa.Array) -> pa.Array:
    text = pc.fill_null(text, "")
    for c in ("\\", "<", ">"):
        text = pc.replace_substring(text, c, "\\" + c)
    return text


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array's bytes and, rebased, where each value starts (and the end)."""
    a = a.cast(pa.binary())
    if not len(a) or a.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    at = np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, a.offset * 4).astype(np.int64)
    return np.frombuffer(a.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def assemble(role: pa.Array, text: pa.Array, bounds: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Turns and each conversation's first turn -> formatted texts, and byte ranges under the loss mask."""
    (roles, r), (texts, t) = _bytes(escape(role)), _bytes(escape(text))
    rlen, tlen = np.diff(r), np.diff(t)
    size = len(HEAD) + rlen + len(MIDDLE) + tlen + len(FOOT)
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(start[-1], np.uint8)
    role_at = start[:-1] + len(HEAD)
    text_at = role_at + rlen + len(MIDDLE)
    for at, what in ((start[:-1], HEAD), (role_at + rlen, MIDDLE), (text_at + tlen, FOOT)):
        out[at[:, None] + np.arange(len(what))] = np.frombuffer(what, np.uint8)
    for at, raw, first, length in ((role_at, roles, r, rlen), (text_at, texts, t, tlen)):
        out[np.repeat(at - first[:-1], length) + np.arange(len(raw))] = raw
    offsets = start[bounds]
    if offsets[-1] >= 1 << 31:
        raise ValueError("a conversation exceeds 2 GB")
    formatted = pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
    loss = pc.fill_null(pc.equal(role, LOSS_ROLE), False).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    begin = text_at - offsets[owner]
    ranges = pa.StructArray.from_arrays([pa.array(begin[loss]), pa.array((begin + tlen)[loss])], ["start", "stop"])
    counts = np.concatenate([[0], np.cumsum(loss)])[bounds]
    return formatted, pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), ranges)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by conversation; the last one of a batch waits, in pieces, for the next batch."""
    held: list[pa.RecordBatch] = []

    def one() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        held.clear()
        size = sum(pc.sum(pc.fill_null(pc.binary_length(table.column(c)), 0)).as_py() for c in ("role", "text"))
        if size >= 1 << 31:
            raise ValueError("a conversation exceeds 2 GB")
        yield _assembled(table.combine_chunks().to_batches()[0])

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id")
        starts = _starts(ids)
        if held and _starts(pa.concat_arrays([held[-1].column("conv_id").slice(held[-1].num_rows - 1), ids.slice(0, 1)])).tolist() == [0]:
            stop = int(starts[1]) if len(starts) > 1 else batch.num_rows
            held.append(batch.slice(0, stop))
            starts = starts[1:]
        if not len(starts):
            continue
        if held:
            yield from one()
        # whole conversations in runs of about RUN_BYTES
        rows = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("role", "text")))
        at, last = 0, len(starts) - 1
        while at < last:
            base = rows[starts[at] - 1] if starts[at] else 0
            to = max(at + 1, int(np.searchsorted(rows[starts[1:] - 1], base + RUN_BYTES, "right")))
            to = min(to, last)
            yield _assembled(batch.slice(int(starts[at]), int(starts[to] - starts[at])))
            at = to
        held.append(batch.slice(int(starts[last])))
    if held:
        yield from one()


def _assembled(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids = batch.column("conv_id")
    new = _starts(ids)
    text, mask = assemble(batch.column("role"), batch.column("text"), np.append(new, len(ids)))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(new)), text, mask], ["conv_id", "formatted", "loss"])


def _starts(ids: pa.Array) -> np.ndarray:
    if len(ids) < 2:
        return np.zeros(len(ids), np.int64)
    a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
    differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return np.concatenate([[0], np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1])


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss`` (byte ranges of ``formatted``)."""
    rows = turns.select(*(F.col(a).alias(b) for a, b in ((conv_col, "conv_id"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.drop("turn").mapInArrow(_format, f"conv_id {kind}, formatted string, loss array<struct<start: bigint, stop: bigint>>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"not a turn at {at}")
        out.append((_ESCAPED.sub(r"\1", m[1]), _ESCAPED.sub(r"\1", m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a turn at {at}")
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
            raw, turns, masked, chars = text.encode(), hashlib.sha256(), hashlib.sha256(), 0
            got = parse(text)
            for role, said in got:
                turns.update(f"{role}\n{said}\n".encode())
            for x in loss:
                part = _ESCAPED_BYTES.sub(rb"\1", raw[x["start"] : x["stop"]])
                masked.update(part)
                chars += len(part.decode())
            rows.append((len(got), turns.hexdigest(), chars, masked.hexdigest(), len(text)))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        )


def digest_chat(chats: DataFrame) -> DataFrame:
    """Reads formatted conversations back: counts and digests of their turns and of the text under the mask."""
    kind = chats.schema["conv_id"].dataType.simpleString()
    return chats.mapInArrow(_digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
