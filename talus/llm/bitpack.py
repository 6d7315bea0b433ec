"""Token ids in fixed-width bit-packed files with block offsets.

A file (all numbers little-endian):
  magic "TALUSBP1", bits u32, ids per block u32, documents u64, ids u64, blocks u64
  per document: doc_id i64, then all known-flags u8, then all ends u64 (ids up to and with the document)
  per block: byte offset u64 from the start of the packed part
  packed part: the blocks, each with its ids one after another, least significant bit first,
  filled up to a whole byte
A document's ids are found by its end and the one before: the blocks between them are unpacked
by numpy and cut. The files of a folder, in the order of their names, hold ascending doc_ids.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.llm import files
from talus.llm.text import crc32_ids, slices
from talus.llm.tokens import encoder
from talus.runtime import new_path, stage

MAGIC = b"TALUSBP1"
HEAD = struct.Struct("<8sIIQQQ")
BLOCK_IDS = 4096
#: Ids after which a file is closed.
FILE_IDS = 32 << 20
#: Documents of a file at most, however short.
FILE_DOCS = 1 << 18
END_ID = 2


def width(vocabulary: int) -> int:
    """The bits that the largest id needs."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = planes
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def file_bytes(doc_ids: list[int | None], ids: list[np.ndarray], bits: int, block: int = BLOCK_IDS) -> Iterator[bytes]:
    lengths = np.array([len(x) for x in ids], np.uint64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    blocks = -(-len(flat) // block)
    size = -(-block * bits // 8)
    yield HEAD.pack(MAGIC, bits, block, len(ids), len(flat), blocks)
    yield np.array([d if d is not None else 0 for d in doc_ids], "<i8").tobytes()
    yield np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    yield np.cumsum(lengths).astype("<u8").tobytes()
    yield (np.arange(blocks, dtype="<u8") * np.uint64(size)).tobytes()
    for k in range(blocks):
        yield pack_bits(flat[k * block : (k + 1) * block], bits)


@dataclass
class PackedFile:
    """A file opened for random access."""

    data: bytes

    def __post_init__(self):
        magic, self.bits, self.block, docs, self.total, blocks = HEAD.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        at = HEAD.size
        self.doc_ids = np.frombuffer(self.data, "<i8", docs, at)
        self.known = np.frombuffer(self.data, np.uint8, docs, at + 8 * docs)
        self.ends = np.frombuffer(self.data, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.offsets = np.frombuffer(self.data, "<u8", blocks, at + 17 * docs).astype(np.int64)
        self.start = at + 17 * docs + 8 * blocks

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        a, b = (int(self.ends[k - 1]) if k else 0), int(self.ends[k])
        if a == b:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        count = min(self.total, (last + 1) * self.block) - first * self.block
        begin = self.start + int(self.offsets[first])
        return unpack_bits(self.data[begin : begin + -(-count * self.bits // 8)], count, self.bits)[a - first * self.block : b - first * self.block]


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of every row of docs (doc_id, text) below path; gives the files' list.

    (uri, part, n, docs, ids) for each file; (part, n) orders them. A null text is empty; a
    null doc_id sorts first; repeated ids stay in their file; texts are encoded whole, however
    long; other columns are ignored; an empty table gives an empty list. Only files of the list
    count: an attempt that was lost leaves files that no list names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, enc = TaskContext.get(), encoder(tokenizer)
        bits, part, n = width(max(enc.vocab, end_id + 1)), task.partitionId(), 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            uri = f"{path}/ids-{part:06d}-{n:05d}-{task.taskAttemptId()}.bp"
            with files.create(uri) as out:
                for piece in file_bytes(doc_ids, ids, bits):
                    out.write(piece)
            return pa.RecordBatch.from_pydict({"uri": [uri], "part": pa.array([part], pa.int32()), "n": pa.array([n], pa.int32()), "docs": [len(ids)], "ids": [held]})

        for batch in slices(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                x = enc.ids(text)
                ids.append(np.append(x, x.dtype.type(end_id)))
                doc_ids.append(doc)
                held += len(x) + 1
                if held >= FILE_IDS or len(ids) >= FILE_DOCS:
                    yield close()
                    doc_ids, ids, held, n = [], [], 0, n + 1
        if ids:
            yield close()

    files.make_folder(path)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id")
    return stage(ordered.mapInArrow(run, "uri string, part int, n int, docs long, ids long"), "bitpack-list")


def read(listed: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files of the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column("uri").to_pylist(), batch.column("before").to_pylist()):
                f = PackedFile(files.read(uri))
                starts = np.concatenate([[0], f.ends[:-1]])
                crc = [crc32_ids(f.document(k)) for k in range(len(f.ends))]
                known = [int(i) if k else None for i, k in zip(f.doc_ids, f.known)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(known, pa.int64()), "start": pa.array(before + starts, pa.int64()), "n_tokens": pa.array(f.ends - starts, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    order = Window.orderBy("part", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = listed.select("uri", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("before"))
    # a task per file of up to FILE_IDS ids
    return placed.repartition(max(1, listed.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files into a new shared folder and read them back."""
    return read(write(docs, tokenizer, new_path(docs.sparkSession, "bitpack")))
