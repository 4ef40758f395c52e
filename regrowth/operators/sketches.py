"""Mergeable sketches as stored partial results: distinct counts and quantiles with a stated error.

A part (a file, a period, a batch) is one small row per key with its sketch in a binary column. Parts are kept, later ones are
added, and any set of them is merged without going back to the rows. The exact operators are ``count_distinct`` and
``quantiles.exact_quantiles``; these are for tables that are too large or grow too often for them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F


def distinct_error(lg_k: int = 12) -> float:
    """Relative error that a distinct estimate keeps within in about 95 of 100 cases."""
    return 2 * 1.04 / math.sqrt(1 << lg_k)


def distinct_parts(df: DataFrame, keys: list[str], column: str, lg_k: int = 12) -> DataFrame:
    """keys, ``sketch``: HyperLogLog of the column's non-null values; combined in each task before the shuffle."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(F.col(column).cast("string"), F.lit(lg_k)).alias("sketch"))


def merged_distinct(parts: DataFrame, keys: list[str], name: str = "n_distinct") -> DataFrame:
    """Estimated distinct values over all parts of a key, and their merged sketch for further merging."""
    merged = parts.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.withColumn(name, F.hll_sketch_estimate("sketch"))


def rank_error(k: int = 200) -> float:
    """Rank error that a quantile estimate of a sketch of size k keeps within in about 99 of 100 cases."""
    return 2.446 / k**0.9433


def quantile_parts(df: DataFrame, keys: list[str], column: str, k: int = 200) -> DataFrame:
    """keys, ``sketch``: KLL of the column's non-null values (k: 8 to 65535); a part without any is left out."""
    return df.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(k)).alias("sketch"))


def merged_quantiles(parts: DataFrame, keys: list[str], probs: list[float], names: list[str]) -> DataFrame:
    """Estimated quantiles over all parts of a key, and their merged sketch for further merging."""
    merged = parts.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    picks = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(n) for p, n in zip(probs, names, strict=True)]
    return merged.select(*keys, *picks, "sketch")
