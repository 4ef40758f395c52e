"""Token ids in directly addressable codes: chunk levels with continuation bitmaps and rank directories.

File ``part-NNNNN.dac``, one per range of ascending document ids, little endian:

    8 bytes   magic ``DACIDS01``
    4 x u64   documents, tokens, levels, bytes of the header (these fields and the tables below)
    per level u64 bytes of chunks, u64 bytes of bitmap, u64 entries of the rank directory
    documents x i64   document ids (the smallest long: null)
    documents x u64   first token of each document in the file
    per level         chunks (one byte each), bitmap (bit i: chunk i goes on in the next level), rank directory (u64: bits
                      set before each block of 512)

A level holds eight bits of every id that still has bits left. The place of token i in the next level is the number of bits
set before i: the directory entry of its block plus the bits inside the block, so any token is reached without decoding others.

Defined cases: a null text is empty and has the end id alone; a null key is written first and read back as null; repeated keys
keep one entry each; an empty table writes no file and gives no row; other columns of the input are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from regrowth.llm.common import as_uri, open_shared, write_whole
from regrowth.llm.tokens import encoder
from regrowth.session import new_work_path

MAGIC = b"DACIDS01"
#: Bits of a rank block; a multiple of 8.
BLOCK = 512
NULL_ID = -(1 << 63)
#: Documents that a reading task returns at a time.
READ_DOCS = 512


def levels_of(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap bytes, rank directory) of each level."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        per_block = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        rank = np.concatenate([np.zeros(1, np.uint64), np.cumsum(per_block, dtype=np.uint64)])
        out.append(((rest & 0xFF).astype(np.uint8), bits, rank))
        if not more.any():
            return out
        rest = rest[more] >> 8


def pack(doc_ids: list[int | None], per_doc: list[np.ndarray]) -> list[bytes]:
    """The pieces of one file."""
    sizes = np.array([len(x) for x in per_doc], dtype=np.uint64)
    starts = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sizes, dtype=np.uint64)])[:-1]
    ids = np.concatenate(per_doc) if per_doc else np.zeros(0, np.uint32)
    levels = levels_of(ids)
    head = 8 + 32 + 24 * len(levels) + 16 * len(doc_ids)
    out = [MAGIC, struct.pack("<4Q", len(doc_ids), len(ids), len(levels), head)]
    out += [struct.pack("<3Q", len(c), len(b), len(r)) for c, b, r in levels]
    out += [np.array([NULL_ID if d is None else d for d in doc_ids], dtype="<i8").tobytes(), starts.astype("<u8").tobytes()]
    for c, b, r in levels:
        out += [c.tobytes(), b.tobytes(), r.astype("<u8").tobytes()]
    return out


class TokenFile:
    """Random access to the tokens of one file; reads only the bytes that it needs."""

    def __init__(self, uri: str):
        self.file = open_shared(uri)
        if self._at(0, 8) != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.n_docs, self.n_tokens, n, head = struct.unpack("<4Q", self._at(8, 32))
        sizes = [struct.unpack("<3Q", self._at(40 + 24 * k, 24)) for k in range(n)]
        self.levels, at = [], head
        for chunks, bits, ranks in sizes:
            self.levels.append((at, at + chunks, at + chunks + bits))
            at += chunks + bits + 8 * ranks
        self._ids_at = 40 + 24 * n

    def _at(self, start: int, size: int) -> bytes:
        return self.file.read_at(size, start)

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """Document ids, and the first token of each with the number of all tokens at the end."""
        ids = np.frombuffer(self._at(self._ids_at, 8 * self.n_docs), dtype="<i8")
        starts = np.frombuffer(self._at(self._ids_at + 8 * self.n_docs, 8 * self.n_docs), dtype="<u8").astype(np.int64)
        return ids, np.append(starts, self.n_tokens)

    def _rank(self, level: int, i: int) -> int:
        """Bits set before place i of a level: one directory entry and at most one block."""
        _, bitmap, directory = self.levels[level]
        block = i // BLOCK
        got = struct.unpack("<Q", self._at(directory + 8 * block, 8))[0]
        if i % BLOCK:
            bits = np.unpackbits(np.frombuffer(self._at(bitmap + block * BLOCK // 8, -(-(i % BLOCK) // 8)), np.uint8), bitorder="little")
            got += int(bits[: i % BLOCK].sum())
        return got

    def token(self, i: int) -> int:
        return int(self.tokens(i, i + 1)[0])

    def tokens(self, a: int, b: int) -> np.ndarray:
        """ids of the tokens a to b - 1."""
        out = np.zeros(b - a, dtype=np.uint32)
        places, level = np.arange(b - a), 0
        while b > a:
            chunks, bitmap, _ = self.levels[level]
            out[places] |= np.frombuffer(self._at(chunks + a, b - a), np.uint8).astype(np.uint32) << np.uint32(8 * level)
            first = a // 8
            bits = np.unpackbits(np.frombuffer(self._at(bitmap + first, -(-b // 8) - first), np.uint8), bitorder="little")
            more = bits[a - 8 * first : b - 8 * first].astype(bool)
            if not more.any():
                break
            a = self._rank(level, a)
            b = a + int(more.sum())
            places, level = places[more], level + 1
        return out


def write_files(docs: DataFrame, vocabulary: str, end_id: int, parts: int, folder: str | None = None, key: str = "doc_id", text: str = "text") -> tuple[str, DataFrame]:
    """Writes the files in ascending key order; returns the folder and one row (part, n_docs, n_tokens) per file.

    Rows are dealt out by ranges of the key, sorted inside a range, encoded and written there; a null key comes first.
    """
    folder = as_uri(folder or new_work_path(docs.sparkSession, "token-files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=np.uint32)
        ids, per_doc = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            got = enc.encode([t or "" for t in batch.column(1).to_pylist()])
            per_doc += [np.concatenate([np.frombuffer(g, enc.dtype), end]).astype(enc.dtype) for g in got]
        if ids:
            name = f"part-{part:05d}.dac"
            write_whole(f"{folder}/{name}", pack(ids, per_doc))
            yield pa.RecordBatch.from_pylist([{"part": part, "n_docs": len(ids), "n_tokens": sum(map(len, per_doc))}])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return folder, rows.mapInArrow(run, "part long, n_docs long, n_tokens long")


def read_documents(spark: SparkSession, folder: str, written: list[tuple[int, int, int]], slots: int) -> DataFrame:
    """One row per document from the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32.

    ``written``: (part, n_docs, n_tokens) of each file; their running sums place the files.
    """
    work, before = [], 0
    for part, _, n_tokens in sorted(written):
        work.append((part, before))
        before += n_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(f"{folder}/part-{row['part']:05d}.dac")
                ids, starts = file.documents()
                for at in range(0, len(ids), READ_DOCS):
                    own = range(at, min(at + READ_DOCS, len(ids)))
                    tokens = [file.tokens(int(starts[i]), int(starts[i + 1])) for i in own]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([None if ids[i] == NULL_ID else int(ids[i]) for i in own], pa.int64()),
                        "start": pa.array([row["before"] + int(starts[i]) for i in own], pa.int64()),
                        "n_tokens": pa.array([len(t) for t in tokens], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(t.astype("<u4").tobytes()) for t in tokens], pa.int64()),
                    })

    rows = spark.createDataFrame(work, "part long, before long")
    return rows.repartition(max(1, min(slots, len(work)))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Encode, append ``end_id`` to each document, write, and read everything back from the files."""
    spark = docs.sparkSession
    # a file is built in memory, so a range must stay small: at least as many ranges as the session shuffles into, and
    # one for every 20,000 rows
    rows = docs.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 20_000), 1)
    folder, files = write_files(docs, vocabulary, end_id, parts)
    written = [(r.part, r.n_docs, r.n_tokens) for r in files.collect()]
    return read_documents(spark, folder, written, parts)
