"""Token counts of documents in flat, unindexed token files, by a scan for separators.

A flat file holds nothing but ids of one width: the tokens of each document, then the end-of-document id. Files are cut into
blocks without looking at them. Each block is searched for separators as one array comparison and gives its number of tokens,
its separators and the tokens behind the last one. A prefix scan over the blocks of a file tells each block how many documents
end before it and how many tokens of an unfinished document it inherits; then every block names its documents by their number
in the file. What follows a file's last separator is one more document that was never closed.

Defined cases: an empty file has no document; two separators in a row enclose a document of no tokens; a separator on a block's
edge belongs to the block that holds it; a file whose size is no multiple of the id width is an error. For documents: a null
text has no tokens; repeated rows are separate documents; an empty table writes no file; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from regrowth.llm.common import as_uri, open_shared, write_whole
from regrowth.llm.tokens import encoder
from regrowth.session import materialise, new_work_path

#: Tokens of a block.
BLOCK = 1 << 20
#: Documents of a file written from a table, at most: a task writes as many files as its rows need.
FILE_DOCS = 4_096


def write_flat(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None) -> tuple[str, DataFrame]:
    """Writes files ``NNNNN-NNNNN.ids``; returns the folder and (file, ordinal, doc_id) of every document written."""
    folder = as_uri(folder or new_work_path(docs.sparkSession, "flat-tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, number = encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, FILE_DOCS):
                own = batch.slice(at, FILE_DOCS)
                name = f"{part:05d}-{number:05d}.ids"
                got = enc.encode([t or "" for t in own.column("text").to_pylist()])
                write_whole(f"{folder}/{name}", [x for g in got for x in (g, end)])
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(got)), pa.array(range(len(got)), pa.int64()), own.column("doc_id")], ["file", "ordinal", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return folder, materialise(rows.mapInArrow(run, "file string, ordinal long, doc_id long"), "flat-order")


def files_in(folder: str, end: str = ".ids") -> list[tuple[str, int]]:
    """(name, bytes) of the finished files."""
    fs, path = pafs.FileSystem.from_uri(folder)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith(end) and not f.base_name.startswith("_"))


def block_documents(ids: np.ndarray, end_id: int) -> tuple[np.ndarray, int]:
    """Tokens of each document that ends in the block, counted from the block's first token, and tokens behind the last."""
    at = np.flatnonzero(ids == end_id)
    return np.diff(at, prepend=-1) - 1, int(len(ids) - 1 - at[-1]) if len(at) else len(ids)


def count_tokens(spark: SparkSession, folder: str, width: int, end_id: int, block: int | None = None) -> DataFrame:
    """file, ordinal, n_tokens of every document in the files of ``folder``; ``width``: bytes of an id."""
    dtype, block = np.dtype(f"<u{width}"), block or BLOCK
    work = []
    for name, size in files_in(folder):
        if size % width:
            raise ValueError(f"{name}: {size} bytes are no whole number of ids")
        work += [(name, a, min(block, size // width - a)) for a in range(0, size // width, block)]
    if not work:
        return spark.createDataFrame([], "file string, ordinal long, n_tokens long")
    slots = max(1, min(len(work), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(open_shared(f"{folder}/{r['file']}").read_at(r["n"] * width, r["a"] * width), dtype)
                sizes, rest = block_documents(ids, end_id)
                yield pa.RecordBatch.from_pylist(
                    [{"file": r["file"], "a": r["a"], "n": r["n"], "ends": len(sizes), "rest": rest, "sizes": sizes.tolist()}],
                    schema=pa.schema([("file", pa.string()), ("a", pa.int64()), ("n", pa.int64()), ("ends", pa.int64()), ("rest", pa.int64()), ("sizes", pa.list_(pa.int64()))]),
                )

    blocks = spark.createDataFrame(work, "file string, a long, n long").repartition(slots)
    blocks = materialise(blocks.mapInArrow(scan, "file string, a long, n long, ends long, rest long, sizes array<long>"), "blocks")
    # the prefix scan: documents that ended before, and where the last of them ended (its end is inherited over any number of
    # blocks without a separator)
    before = Window.partitionBy("file").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("file").orderBy(F.col("a").desc())
    placed = blocks.select("file", "a", "n", "ends", "rest").select(
        "*", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("first"),
        F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("a") + F.col("n") - F.col("rest"))).over(before), F.lit(0)).alias("since"),
        (F.row_number().over(last) == 1).alias("final"),
    )
    placed = placed.join(blocks.select("file", "a", "sizes"), ["file", "a"])
    each = placed.select("file", "a", "first", "since", F.posexplode("sizes").alias("i", "size")).select(
        "file", (F.col("first") + F.col("i")).alias("ordinal"), F.when(F.col("i") == 0, F.col("size") + F.col("a") - F.col("since")).otherwise(F.col("size")).alias("n_tokens"),
    )
    tail = placed.where("final").select(
        "file", (F.col("first") + F.col("ends")).alias("ordinal"),
        F.when(F.col("ends") > 0, F.col("rest")).otherwise(F.col("a") + F.col("n") - F.col("since")).alias("n_tokens"),
    ).where("n_tokens > 0")
    return each.unionByName(tail)


def document_counts(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, file, ordinal, n_tokens: the documents written as flat files and counted by the scan alone.

    The scan knows files and numbers; the writer's order, joined at the end, gives the ids.
    """
    folder, order = write_flat(docs, vocabulary, end_id)
    counts = count_tokens(docs.sparkSession, folder, encoder(vocabulary).dtype.itemsize, end_id)
    return order.join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
