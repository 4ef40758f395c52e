"""Grouped summaries. Everything here is partial + final aggregation; no group is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from regrowth.functions.columns import standard_error


def mean_se(df: DataFrame, keys: list[str], value: str, min_n: int = 1) -> DataFrame:
    """n, mean and standard error (n-1 variance) of the non-null values."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), standard_error(value).alias("se"))
        .where(F.col("n") >= min_n)
    )


def named_groups(df: DataFrame, key: str) -> DataFrame:
    """Rows whose group name is neither NULL nor empty."""
    return df.where(F.col(key).isNotNull() & (F.col(key) != ""))


def add_share(df: DataFrame, value: str, name: str, percent: bool = False) -> DataFrame:
    """Share of the grand total, the total taken by a scalar subquery."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(name, F.col(value) / total * F.lit(100.0 if percent else 1.0))


def with_total(df: DataFrame, keys: list[str], aggs: list[Column], all_label: str = "all") -> DataFrame:
    """One 'all' row plus one row per value of each key column, from one grouping-sets pass.

    Output: grouping (which key), level (its value), aggregates.
    """
    sets = [[]] + [[k] for k in keys]
    grouped = df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
        *aggs, *[F.grouping(k).alias(f"_g_{k}") for k in keys]
    )
    which, level = F.lit(all_label), F.lit(all_label)
    for k in keys:
        which = F.when(F.col(f"_g_{k}") == 0, F.lit(k)).otherwise(which)
        level = F.when(F.col(f"_g_{k}") == 0, F.col(k).cast("string")).otherwise(level)
    return grouped.withColumn("grouping", which).withColumn("level", level).drop(*keys, *[f"_g_{k}" for k in keys])


def paired_errors(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Bias, root mean square error and correlation of y against x over complete pairs."""
    d = F.col(y) - F.col(x)
    return (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(d).alias("bias"),
            F.sqrt(F.avg(d * d)).alias("rmse"),
            F.corr(x, y).alias("r"),
        )
    )


def simple_regression(df: DataFrame, keys: list[str], x: str, y: str, min_n: int = 2) -> DataFrame:
    d = F.col(y) - F.col(x)
    return (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.regr_slope(F.col(y), F.col(x)).alias("slope"),
            F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
            F.corr(x, y).alias("r"),
            F.avg(d).alias("bias"),
            F.stddev_pop(d).alias("sd_diff"),
            F.avg(x).alias("mean_ref"),
        )
        .where(F.col("n") >= min_n)
    )


def pooled_by_variance(df: DataFrame, keys: list[str], value: str, se: str) -> DataFrame:
    """Inverse-variance mean, its SE and Cochran's Q, from one pass over (value, se) rows."""
    w = 1 / (F.col(se) * F.col(se))
    v = F.col(value)
    sums = df.where((F.col(se) > 0) & v.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("_w"), F.sum(w * v).alias("_wv"), F.sum(w * v * v).alias("_wvv")
    )
    return sums.select(
        *keys,
        "n",
        (F.col("_wv") / F.col("_w")).alias("pooled"),
        F.sqrt(1 / F.col("_w")).alias("pooled_se"),
        (F.col("_wvv") - F.col("_wv") * F.col("_wv") / F.col("_w")).alias("q"),
        (F.col("n") - 1).alias("df"),
    )


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
    )


def non_null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with the number of values present."""
    one = df.agg(*[F.count(x).alias(x) for x in columns])
    pairs = F.array(*[F.struct(F.lit(x).alias("column_name"), F.col(x).alias("n")) for x in columns])
    return one.select(F.inline(pairs))


def merge_partials(frames: list[DataFrame], keys: list[str], sums: list[str]) -> DataFrame:
    """Add up partial accumulators that arrive from many files."""
    first, *rest = frames
    for f in rest:
        first = first.unionByName(f, allowMissingColumns=True)
    return first.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])


def composite(df: DataFrame, keys: list[str], value: str, least: int = 3) -> DataFrame:
    """Mean of the observations where at least ``least`` are clear, NULL otherwise, with the count."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n_clear"), F.avg(value).alias("_m"))
    return out.withColumn("mean", F.when(F.col("n_clear") >= least, F.col("_m"))).drop("_m")


def unit_anomaly(df: DataFrame, unit: str, period: str, value: str, least: int = 10) -> DataFrame:
    """Mean over units of (value - the unit's own mean) per period, units with ``least`` values only."""
    own = df.where(F.col(value).isNotNull()).groupBy(unit).agg(F.avg(value).alias("_own"), F.count(value).alias("_n"))
    joined = df.where(F.col(value).isNotNull()).join(own.where(F.col("_n") >= least), unit)
    return joined.groupBy(period).agg(F.avg(F.col(value) - F.col("_own")).alias("anomaly"), F.count(F.lit(1)).alias("n"))
