"""Reading, writing, merging and fingerprinting tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from regrowth.functions.columns import utc_micros


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is the only missing marker of the inputs; Spark needs NULL to skip it."""
    fix = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.withColumns(fix) if fix else df


def scan_table(spark: SparkSession, path: str, columns: list[str] | None = None, clean_nan: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    return nan_to_null(df) if clean_nan else df


def scan_json_dimension(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """JSON objects ``{code: {fields}}``, one on a line -> one row per code."""
    raw = spark.read.text(path)
    parsed = F.from_json("value", f"map<string, struct<{fields}>>")
    return raw.select(F.explode(parsed).alias("code", "item")).select("code", "item.*")


def scan_json_lists(spark: SparkSession, path: str) -> DataFrame:
    """Scene lists ``[{id, used, clear_px}]``, one file per period; the period comes from the file name."""
    df = spark.read.schema("id string, used boolean, clear_px bigint").json(path, multiLine=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/=]+)_items[^/]*(/[^/]*)?$", 1)
    return df.withColumn("epoch", F.regexp_replace(name, "%20", " "))


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Rows meet by partition value; adaptive execution splits a hot value over tasks by its size, and joins small ones."""
    if partition_by:
        df = df.hint("rebalance", *[F.col(p) for p in partition_by])
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def merge_results(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: new rows win, old rows with other keys stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_slices(table: DataFrame, fresh: DataFrame, column: str) -> DataFrame:
    """Drop every slice named in ``fresh`` and append the fresh rows."""
    kept = table.join(fresh.select(column).distinct(), [column], "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def replace_partitions(fresh: DataFrame, path: str, by: list[str]) -> None:
    """Write ``fresh`` over the slices of the table at ``path`` that it names; the others are not touched.

    Slices are partition folders. The rows are staged and take the old slices' places when all of them are there, so a write
    that fails leaves the table as it was, and repeating one gives the same table. A slice without fresh rows stays.
    """
    rows = fresh.hint("rebalance", *[F.col(p) for p in by])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """Order-free checksum of a table: row count, the xor and the wrapping sum of exact per-row digests.

    Equal rows cancel in the xor but add up in the sum. Every value is preceded by its length, and NULL by none, so that no
    two rows have the same text.
    """
    parts = []
    for field in df.schema:
        is_time = field.dataType.typeName() in ("timestamp", "timestamp_ntz")
        value = utc_micros(df, field.name) if is_time else F.col(field.name)
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.char_length(text), F.lit(":"), text), F.lit("~")))
    digest = F.md5(F.concat_ws("|", *parts))
    half = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    return df.select(half.alias("h")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("checksum"),
        (F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)) % F.lit(1 << 60)).cast("long").alias("total"),
    ).select(F.lit(name).alias("table_name"), "n_rows", "checksum", "total")


def present(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted columns that the table really has."""
    have = set(df.columns)
    return [w for w in wanted if w in have]


def union_evolving(frames: list[DataFrame]) -> DataFrame:
    """Append frames whose columns drifted; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
