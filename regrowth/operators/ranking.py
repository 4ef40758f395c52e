"""Top-k, global ranks and samples without a single-task sort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from regrowth.functions.draws import uniform
from regrowth.operators.quantiles import n_ranges, range_of


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of each group. Rows are thinned within salted slices first, so a hot group is shared out."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(n_ranges(df)))
    slices = df.withColumn("_salt", salt)
    slices = slices.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("_r") <= k)
    name = rank or "_r"
    out = slices.drop("_salt", "_r").withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop("_r")


def global_row_number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Dense 1..n numbering of distinct ``order`` tuples over the whole table, ascending; NULL counts as a value and comes first.

    A bounded, hash-chosen set of tuples cuts the key space into slices; each slice is numbered on its own and
    shifted by the sizes of the slices before it.
    """
    n_cuts = n_ranges(df) - 1
    key = F.struct(*order)
    pool = df.select(*order).distinct()
    picked = pool.orderBy(F.xxhash64(*order)).limit(n_cuts).agg(F.sort_array(F.collect_list(key)).alias("_cuts"))
    cut = df.withColumn("_cuts", picked.scalar())
    sliced = cut.withColumn("_slice", range_of(F.col("_cuts"), key, n_cuts)).drop("_cuts")
    sizes = sliced.groupBy("_slice").agg(F.count_distinct(key).alias("_size"))
    shift = F.coalesce(F.sum("_size").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_slice", shift.alias("_shift"))  # at most n_cuts + 1 rows
    ranked = sliced.withColumn("_local", F.dense_rank().over(W.partitionBy("_slice").orderBy(*order)))
    return ranked.join(offsets, "_slice").withColumn(name, (F.col("_local") + F.col("_shift")).cast("long")).drop(
        "_slice", "_local", "_shift"
    )


def hashed_rank(df: DataFrame, key: str, rank: str, total: str) -> DataFrame:
    """0-based position of each (unique) key in md5 order, plus the number of keys.

    md5 prefixes are even slices of the key space by construction, so no sampling is needed.
    """
    digits = 3 if n_ranges(df) <= 1 << 12 else 4
    hashed = df.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_slice", F.substring("_h", 1, digits))
    sizes = hashed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_size"))
    w = W.orderBy("_slice")  # one row per slice
    offsets = sizes.select(
        "_slice",
        F.coalesce(F.sum("_size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_shift"),
        F.sum("_size").over(W.partitionBy()).alias(total),
    )
    local = F.row_number().over(W.partitionBy("_slice").orderBy("_h", key)) - 1
    return (
        hashed.withColumn("_local", local)
        .join(offsets, "_slice")
        .withColumn(rank, F.col("_local") + F.col("_shift"))
        .drop("_h", "_slice", "_local", "_shift")
    )


def exact_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer) with the smallest keyed draws; ``key`` must be unique."""
    drawn = df.withColumn("_u", uniform(F.lit(seed), key)).withColumn("_slice", F.floor(F.col("_u") * n_ranges(df, least=4096, most=1 << 16)).cast("int"))
    sizes = drawn.groupBy("_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_slice", "_size", before.alias("_before")).where(F.col("_before") < n)
    placed = drawn.join(offsets, "_slice")
    whole = placed.where(F.col("_before") + F.col("_size") <= n)
    cut = placed.where(F.col("_before") + F.col("_size") > n)
    cut = cut.withColumn("_r", F.row_number().over(W.partitionBy("_slice").orderBy("_u", key)) + F.col("_before")).where(
        F.col("_r") <= n
    )
    return whole.unionByName(cut.drop("_r")).drop("_u", "_slice", "_size", "_before")


def every_nth(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Rows 1, n+1, 2n+1, ... in key order; rows with equal keys are counted one by one."""
    numbered = global_row_number(df, order, "_group")
    sizes = df.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
    tied = numbered.withColumn("_tie", F.row_number().over(W.partitionBy("_group").orderBy(*[F.xxhash64(*df.columns)])))
    # the place of a group's first row: all rows of the groups before it, by slices of groups
    groups = global_row_number(sizes, order, "_group").withColumn("_slice", F.floor(F.col("_group") / 10_000))
    totals = groups.groupBy("_slice").agg(F.sum("_n").alias("_s"))
    ahead = totals.select("_slice", F.coalesce(F.sum("_s").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inside = F.coalesce(F.sum("_n").over(W.partitionBy("_slice").orderBy("_group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = groups.withColumn("_inside", inside).join(ahead, "_slice").select("_group", (F.col("_ahead") + F.col("_inside")).alias("_first"))
    row = F.col("_first") + F.col("_tie") - 1
    return tied.join(first, "_group").where(row % n == 0).drop("_group", "_tie", "_first")


def sample_per_stratum(df: DataFrame, stratum: list[str], key: str, k: int, seed: str) -> DataFrame:
    drawn = df.withColumn("_u", uniform(F.lit(seed), key))
    return top_k_per_group(drawn, stratum, [F.col("_u"), F.col(key)], k).drop("_u")


def thin_evenly(df: DataFrame, group: list[str], value: str, most: int) -> DataFrame:
    """At most ``most`` evenly spaced distinct values per group, starting with the first."""
    distinct = df.select(*group, value).distinct()
    n = F.count(F.lit(1)).over(W.partitionBy(*group))
    pos = F.row_number().over(W.partitionBy(*group).orderBy(value)) - 1
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most)).cast("long")
    return (
        distinct.withColumn("_n", n)
        .withColumn("_pos", pos)
        .withColumn("_step", step)
        .where((F.col("_pos") % F.col("_step") == 0) & (F.col("_pos") / F.col("_step") < most))
        .drop("_n", "_pos", "_step")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
