"""Exact quantiles, by two operators for two shapes of data; the caller picks.

``exact_quantiles`` is for groups of any width: a bounded sketch of the rows cuts each group into value ranges, rows are counted
by range with map-side combine, and only the ranges that hold a wanted rank are counted by value and ordered. The values and
the sketch are written first: a sketch depends on the order in which its parts are merged and a value derived from sums on the order
of the sums, so a second derivation may cut the ranges elsewhere than the one that was counted. ``small_quantiles`` is one aggregate
for very many groups of few values each; it keeps a group's distinct values in one buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from regrowth.session import materialise


def range_of(edges: Column, value: Column, n_edges: int) -> Column:
    """Number of sorted edges <= value, by halving (log2 steps per row)."""
    steps, step = [], (n_edges + 1) // 2
    while step:
        steps.append(step)
        step //= 2
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda pos, s: F.when(F.get(edges, pos + s - F.lit(1)) <= value, pos + s).otherwise(pos),
    )


def n_ranges(df: DataFrame, per_partition: int = 4, least: int = 64, most: int = 4096) -> int:
    """Ranges to cut a table or group into: a few for each shuffle partition, as a power of two so that halving finds one."""
    n = max(least, per_partition * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return min(most, 1 << (n - 1).bit_length())


def small_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], names: list[str], min_n: int = 1, count: str | None = None) -> DataFrame:
    """Like ``exact_quantiles``, for groups of few distinct values."""
    out = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("_total"), F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(p)) for p in probs])).alias("_q")
    )
    picks = [F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(names)]
    return out.where(F.col("_total") >= min_n).select(*keys, *([F.col("_total").alias(count)] if count else []), *picks)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], names: list[str], min_n: int = 1, count: str | None = None, repeated: bool = False) -> DataFrame:
    """One row per group with linearly interpolated quantiles; groups below ``min_n`` values are left out.

    ``count`` names an output column for the number of non-null values. ``repeated`` says that values occur many times: they are then
    counted with map-side combine first, and all that follows works on the distinct values of each group.
    """
    groups, edges = keys, n_ranges(df) - 1
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    n, weight = F.lit(1), []
    if repeated:
        rows, n, weight = rows.groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_n")), F.col("_n"), ["_n"]
    rows = materialise(rows, "quantile-values")
    steps = [(i + 1) / (edges + 1) for i in range(edges)]
    sketch = rows.groupBy(*groups).agg(F.percentile_approx("_v", steps, 4 * (edges + 1)).alias("_edges"), F.sum(n).alias("_total"))
    sketch = materialise(sketch, "quantile-ranges")
    if groups:
        ranged = _eq_join(rows, sketch.where(F.col("_total") >= min_n), groups)
    else:
        ranged = rows.withColumn("_s", sketch.select(F.struct("_edges", "_total")).scalar())
        ranged = ranged.select("_v", *weight, "_s.*").where(F.col("_total") >= min_n)
    ranged = ranged.withColumn("_range", range_of(F.col("_edges"), F.col("_v"), edges)).drop("_edges")

    by_range = ranged.groupBy(*groups, "_range", "_total").agg(F.sum(n).alias("_in_range"))
    # at most one row per range and group
    before = F.coalesce(
        F.sum("_in_range").over(W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    by_range = by_range.withColumn("_before", before)
    # wanted zero-based positions: floor and ceiling of p * (n - 1) for each probability
    spots = F.array(
        *[
            F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("pos"))
            for i, p in enumerate(probs)
        ]
    )
    wanted = (
        by_range.withColumn("_spot", F.explode(spots))
        .withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("_rank", F.when(F.col("_side") == 0, F.floor("_spot.pos")).otherwise(F.ceil("_spot.pos")).cast("long"))
        .where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_in_range")))
        .groupBy(*groups, "_range", "_before", "_total")
        .agg(F.collect_set(F.struct(F.col("_spot.i").alias("i"), "_side", "_rank", F.col("_spot.pos").alias("pos"))).alias("_want"))
    )
    # of the ranges that hold a wanted rank, the values with their counts
    kept = _eq_join(ranged.select(*groups, "_range", "_v", *weight), wanted.select(*groups, "_range"), groups + ["_range"])
    values = kept.groupBy(*groups, "_range", "_v").agg(F.sum(n).alias("_n"))
    inside = _eq_join(values, wanted, groups + ["_range"])
    upto = F.col("_before") + F.sum("_n").over(W.partitionBy(*groups, "_range").orderBy("_v"))
    hits = (
        inside.withColumn("_upto", upto)
        .withColumn("_hit", F.explode(F.filter("_want", lambda x: (x["_rank"] < F.col("_upto")) & (x["_rank"] >= F.col("_upto") - F.col("_n")))))
        .select(*groups, "_total", "_v", "_hit.*")
    )
    picks = []
    for i, name in enumerate(names):
        low = F.max(F.when((F.col("i") == i) & (F.col("_side") == 0), F.col("_v")))
        high = F.max(F.when((F.col("i") == i) & (F.col("_side") == 1), F.col("_v")))
        pos = F.max(F.when(F.col("i") == i, F.col("pos")))
        picks.append((low + (high - low) * (pos - F.floor(pos))).alias(name))
    out = hits.groupBy(*groups, "_total").agg(*picks)
    return out.withColumnRenamed("_total", count) if count else out.drop("_total")


def _eq_join(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe equi-join; AQE broadcasts the small side only when its measured size allows, else splits hot keys."""
    right = small.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    cond = None
    for k in keys:
        term = big[k].eqNullSafe(right[f"_r_{k}"])
        cond = term if cond is None else cond & term
    return big.join(right, cond).drop(*[f"_r_{k}" for k in keys])


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median", min_n: int = 1) -> DataFrame:
    return exact_quantiles(df, keys, value, [0.5], [name], min_n)


def quantile_scalar(df: DataFrame, value: str, prob: float) -> Column:
    """A whole-table quantile as a scalar subquery."""
    return exact_quantiles(df, [], value, [prob], ["q"]).scalar()
