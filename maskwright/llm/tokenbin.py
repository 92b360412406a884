"""Token-id files of fixed-width bit-packed ids.

A shard holds whole documents in ascending id order:

    magic, then blocks of ``BLOCK`` ids (the last may be shorter), every id in
    ``width`` bits, least significant bit first, each block on a byte border;
    a footer: block offsets (u64), first id of every document and the end
    (u64), the document ids as an Arrow stream; then a tail of fixed size with
    width, number of ids, blocks, documents and the footer's parts.

``width`` is the least number of bits that holds the vocabulary.  Any document
is read by seeking to the blocks that hold it.

Executors write shards under names of their own attempt in the shared folder;
the manifest, a written table, names the shards that count.

Cases: null text is empty and holds only the end id; a null id comes first;
rows repeating an id follow each other, ordered by a hash of their text; an
empty table makes no shard; only the id and text columns are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, new_path
from ._tokens import END_ID, default_tokenizer, encoded

MAGIC = b"MWIDS001"
BLOCK = 1 << 15
_TAIL = struct.Struct("<IIQQQQ8s")


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits, bitorder="little").tobytes()


def unpack_bits(raw: bytes | memoryview, count: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    out = np.zeros((count, 32), np.uint8)
    out[:, :width] = bits
    return np.packbits(out, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """Streams one shard to ``out``; holds one block and the documents' index."""

    def __init__(self, out, width: int, block: int = BLOCK):
        self.out, self.width, self.block = out, width, block
        self.rest = np.zeros(0, np.uint32)
        self.at, self.total, self.offsets, self.starts, self.docs = len(MAGIC), 0, [], [0], []
        out.write(MAGIC)

    def _blocks(self, ids: np.ndarray) -> None:
        for i in range(0, len(ids), self.block):
            raw = pack_bits(ids[i : i + self.block], self.width)
            self.offsets.append(self.at)
            self.out.write(raw)
            self.at += len(raw)

    def add(self, docs: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError("an id needs more bits than the vocabulary has")
        self.docs.append(docs)
        self.starts += (bounds[1:] + self.total).tolist()
        self.total += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // self.block * self.block
        self._blocks(ids[:whole])
        self.rest = ids[whole:].copy()

    def close(self) -> None:
        self._blocks(self.rest)
        docs = pa.chunked_array(self.docs).combine_chunks() if self.docs else pa.nulls(0, pa.int64())
        sink = pa.BufferOutputStream()
        table = pa.table({"doc_id": docs})
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        names = sink.getvalue().to_pybytes()
        self.out.write(np.array(self.offsets, "<u8").tobytes() + np.array(self.starts, "<u8").tobytes() + names)
        self.out.write(_TAIL.pack(self.width, self.block, self.total, len(self.offsets), len(self.starts) - 1, len(names), MAGIC))


class Reader:
    """Random access to a shard: only the footer and the blocks asked for are read."""

    def __init__(self, path: str):
        system, place = pa.fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        self.width, self.block, self.total, blocks, docs, names, magic = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{path} isn't a file of token ids")
        length = 8 * blocks + 8 * (docs + 1) + names
        foot = self.file.read_at(length, size - _TAIL.size - length)
        self.offsets = np.frombuffer(foot, "<u8", blocks).astype(np.int64)
        self.starts = np.frombuffer(foot, "<u8", docs + 1, 8 * blocks).astype(np.int64)
        self.doc_id = pa.ipc.open_stream(foot[length - names :]).read_all().column("doc_id").combine_chunks()

    def ids(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.zeros(0, np.uint32)
        out = []
        for b in range(start // self.block, (stop - 1) // self.block + 1):
            count = min(self.block, self.total - b * self.block)
            raw = self.file.read_at(-(-count * self.width // 8), int(self.offsets[b]))
            out.append(unpack_bits(raw, count, self.width))
        base = start // self.block * self.block
        return np.concatenate(out)[start - base : stop - base]

    def doc(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def close(self) -> None:
        self.file.close()


def _write(folder: str, path: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, place = pa.fs.FileSystem.from_uri(folder)
        name = f"shard-{context.partitionId():06d}-{uuid.uuid4().hex}.ids"
        out = writer = None
        for part, ids, bounds in encoded(batches, path, end_id):
            if writer is None:
                out = system.open_output_stream(f"{place}/{name}")
                writer = Writer(out, width)
            writer.add(part.column("doc_id"), ids, bounds)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([context.partitionId()], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": [len(writer.starts) - 1], "n_ids": [writer.total]})

    return run


def write_token_files(
    spark: SparkSession, docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, vocabulary: int | None = None
) -> DataFrame:
    """Writes shards in ascending id order; returns the manifest ``shard, path, n_docs, n_ids``."""
    tokenizer = tokenizer or default_tokenizer()
    if vocabulary is None:
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    folder = folder or new_path(spark, "token-ids")
    system, place = pa.fs.FileSystem.from_uri(folder)
    system.create_dir(place)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = rows.mapInArrow(_write(folder, tokenizer, end_id, width_of(vocabulary)), "shard int, path string, n_docs long, n_ids long")
    return Scratch(spark).keep(manifest, "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            shard = Reader(path)
            step = 1 << 12
            for i in range(0, len(shard.starts) - 1, step):
                starts = shard.starts[i : i + step + 1]
                raw = shard.ids(int(starts[0]), int(starts[-1])).astype("<u4").tobytes()
                at = ((starts - starts[0]) * 4).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [shard.doc_id.slice(i, len(crc)), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )
            shard.close()


def read_token_files(spark: SparkSession, manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """One row per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    base, rows = 0, []
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):  # one row for each file
        rows.append((r["path"], base))
        base += r["n_ids"]
    shards = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return shards.mapInArrow(_read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
