"""Difference-in-differences: each unit's period before the event against the period after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from regrowth.functions.columns import standard_error
from regrowth.operators.aggregate import with_total


def pre_post(long: DataFrame, unit: str, year: str, value: str, keep: list[str]) -> DataFrame:
    """Value of the last full period before the event (flagged ``is_pre``) and of the period after the event year.

    One grouped pass over the panel instead of a self-join.
    """
    pre = F.max(F.when(F.col("is_pre"), F.col(value)))
    post = F.max(F.when(F.col("yr") == F.col(year) + 1, F.col(value)))
    rows = long.where(F.col("is_pre") | (F.col("yr") == F.col(year) + 1))
    out = rows.groupBy(unit, year, *keep).agg(pre.alias("pre_v"), post.alias("post_v"))
    return out.where(F.col("pre_v").isNotNull() & F.col("post_v").isNotNull()).withColumn("did_v", F.col("post_v") - F.col("pre_v"))


def did_aggs() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg("pre_v").alias("pre"),
        F.avg("post_v").alias("post"),
        F.avg("did_v").alias("did"),
        standard_error("did_v").alias("se"),
    ]


def did_by(df: DataFrame, keys: list[str], min_n: int = 8) -> DataFrame:
    return df.groupBy(*keys).agg(*did_aggs()).where(F.col("n") >= min_n)


def did_with_total(df: DataFrame, cohort: str, group: str, min_n: int = 8) -> DataFrame:
    """Per cohort: an 'all' row and one row per named group, for cohorts that reach the gate."""
    sets = df.groupingSets([[F.col(cohort)], [F.col(cohort), F.col(group)]], F.col(cohort), F.col(group)).agg(
        *did_aggs(), F.grouping(group).alias("_total")
    )
    rows = sets.where((F.col("n") >= min_n) & ((F.col("_total") == 1) | F.col(group).isNotNull()))
    return rows.withColumn(group, F.when(F.col("_total") == 1, "all").otherwise(F.col(group))).drop("_total")


def did_pooled(df: DataFrame, groups: list[str], year: str, min_n: int = 8) -> DataFrame:
    """One 'all' row and one row per level of each grouping column, with the range of event years."""
    aggs = did_aggs() + [F.min(year).alias("year0"), F.max(year).alias("year1")]
    rows = with_total(df, groups, aggs)
    return rows.where((F.col("n") >= min_n) & F.col("level").isNotNull() & (F.col("level") != ""))
