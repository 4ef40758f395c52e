"""Joins of the panel: cohorts before and after, sensor calibration chains, tolerance matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def cohort_pre_post(long: DataFrame, unit: str, year: str, obs_year: str, value: str, keep: list[str]) -> DataFrame:
    """Each unit's value one year before and one year after its event, in one grouped pass."""
    offset = F.col(obs_year) - F.col(year)
    rows = long.where(offset.isin(-1, 1))
    g = rows.groupBy(unit, year, *keep).agg(
        F.max(F.when(offset == -1, F.col(value))).alias("pre_v"), F.max(F.when(offset == 1, F.col(value))).alias("post_v")
    )
    return g.where(F.col("pre_v").isNotNull() & F.col("post_v").isNotNull())


def chain_calibration(points: DataFrame, links: list[DataFrame], value: str, se: str, keys: list[str]) -> DataFrame:
    """Carry a value back through one or more calibration lines, over every combination of lines.

    Each link (slope, intercept) holds the few calibrations of one sensor step: it becomes one array value that meets every
    point, so nothing is joined. ``se_eq`` divides the standard error by the product of the smallest slopes.
    """
    rows, den = points.withColumn("_v", F.col(value)), F.lit(1.0)
    for i, link in enumerate(links):
        lines = link.agg(F.collect_list(F.struct("slope", "intercept")).alias("l"), F.min("slope").alias("m"))
        rows = rows.withColumn(f"_k{i}", lines.select(F.struct("l", "m")).scalar()).withColumn("_line", F.explode(f"_k{i}.l"))
        back = F.try_divide(F.col("_v") - F.col("_line.intercept"), F.col("_line.slope"))
        rows = rows.withColumns({"_v": back, f"_m{i}": F.col(f"_k{i}.m")}).drop("_line", f"_k{i}")
        den = den * F.col(f"_m{i}")
    return rows.withColumn("_den", den).groupBy(*keys, value, se).agg(
        F.min("_v").alias("eq_lo"), F.max("_v").alias("eq_hi"), F.avg("_v").alias("eq_mid"), F.count(F.lit(1)).alias("n_chains"),
        F.try_divide(F.first(se), F.first("_den")).alias("se_eq"),
    )


def tolerance_sums(left: DataFrame, right: DataFrame, keys: list[str], row: str, left_value: str, right_value: str, tol: float, cuts: int = 16) -> DataFrame:
    """(row, n, total): number and sum of right values within ``tol`` of each left row's value, on equal keys.

    Right rows are summed by buckets of width tol / cuts. The buckets that lie inside the band are met as sums, and only the
    buckets at its two ends as rows.
    """
    width = tol / cuts
    bucket = lambda c: F.floor(c / width)
    v = F.col(left_value)
    first, last = bucket(v - tol), bucket(v + tol)
    sums = right.groupBy(*keys, bucket(F.col(right_value)).alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.sum(right_value).alias("total"))
    inner = left.select(row, *keys, F.explode(F.sequence(first + 1, last - 1)).alias("_b")).join(sums, [*keys, "_b"]).select(row, "n", "total")
    ends = left.select(row, *keys, left_value, F.explode(F.array(first, last)).alias("_b"))
    pairs = ends.join(right.select(*keys, right_value, bucket(F.col(right_value)).alias("_b")), [*keys, "_b"])
    pairs = pairs.where(F.abs(v - F.col(right_value)) <= tol).select(row, F.lit(1).cast("long").alias("n"), F.col(right_value).alias("total"))
    return inner.unionByName(pairs).groupBy(row).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
