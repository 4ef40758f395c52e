"""Incremental composites and unit accumulators with Structured Streaming.

Each micro-batch writes the updated sums of the keys it touched under its batch number. Writing a batch again
replaces it, so a retry changes nothing, and the current state of a key is the row with the highest batch number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from regrowth.session import new_work_path


def read_scene_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_sums(stream: DataFrame, keys: list, value: str, time: str = "ts", id_column: str | None = None, late: str = "60 days") -> DataFrame:
    """n and sum per key; with ``id_column`` a record that arrives twice within the watermark counts once."""
    marked = stream.withWatermark(time, late)
    if id_column:
        marked = marked.dropDuplicatesWithinWatermark([id_column])
    return marked.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"))


def run_to_table(sums: DataFrame, name: str) -> str:
    """Process everything available and return the folder with one sub-folder per batch."""
    spark = sums.sparkSession
    out, state = new_work_path(spark, name), new_work_path(spark, f"{name}-state")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        sums.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return out


def latest_state(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest row of every key."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in keys and c != "batch"]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_s"))
    return newest.select(*keys, "_s.*")


def stage_as_files(df: DataFrame, order: str, batches: int = 4) -> tuple[str, int]:
    """Write a bounded table as files in time order, as arriving scenes would be laid out.

    As many files as the session shuffles into; returns the folder and the files of one micro-batch.
    """
    path = new_work_path(df.sparkSession, "arrivals")
    n_files = max(batches, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df.repartitionByRange(n_files, order).write.parquet(path)
    return path, -(-n_files // batches)
