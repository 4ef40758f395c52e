"""Sharding by jump consistent hashing: no ring table, and a further shard takes rows only into itself.

Defined cases: a null key hashes like one fixed key; a null text has size 16 and the checksum of no bytes; repeated rows
share a shard and take one slot each (which of them takes which is free); an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from regrowth.session import materialise

#: Multiplier of the jump recurrence (fixed value of the published algorithm).
STEP = np.uint64(2862933555777941757)
#: Rows that one numbering task sorts, about.
ROWS_PER_BUCKET = 50_000


def jump(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each 64-bit key; all keys jump together, the few that have not yet passed ``n_shards`` go on."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    key = np.ascontiguousarray(keys).astype(np.int64).view(np.uint64).copy()
    out = np.zeros(len(key), dtype=np.int64)
    going = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(going):
            k = key[going] * STEP + np.uint64(1)
            key[going] = k
            spot = np.floor((out[going] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0)))
            stay = spot < n_shards
            going = going[stay]
            out[going] = spot[stay].astype(np.int64)
    return out


def jump_column(key, n_shards: int):
    """The shard of a long column as a Spark column; only the keys cross to Python, in Arrow batches."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), n_shards).astype(np.int32))

    return shard(key)


def shard_rows(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard (the shard if there were one more).

    Slots are gapless from 0 in each shard. A shard is numbered in many hash buckets at once: counts of the buckets give
    each bucket its first slot, so no task sorts a whole shard. The bucket hashes a row number that is written with the rows too,
    so one key that holds a third of the rows is numbered in all buckets of its shard. ``buckets`` (per shard) follows the row count by default.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(key).cast("long")).alias("_key"), F.monotonically_increasing_id().alias("_row"),
    )
    rows = rows.withColumns({"shard": jump_column(F.col("_key"), n_shards), "grown_shard": jump_column(F.col("_key"), n_shards + 1)})
    rows = materialise(rows, "shards")
    if buckets is None:
        buckets = max(64, -(-rows.count() // (n_shards * ROWS_PER_BUCKET)))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_key", "_row"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size", "_row")
    numbered = rows.withColumn("_at", F.row_number().over(within) - 1)
    return numbered.join(first, ["shard", "_bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("_first") + F.col("_at")).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"),
    )
