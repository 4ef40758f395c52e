"""Age bins, named bands and overlapping strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from regrowth.functions.columns import c

FIRST_AGE = 0.6


def age_bin(age="age", start: float = FIRST_AGE, step: float = 1.0) -> Column:
    """Index b of the half-open bin [start + b*step, start + (b+1)*step).

    floor() alone can miss by one at an edge because ``age - start`` is rounded, so the guess is compared with
    the edges themselves.
    """
    a, s, w = c(age), F.lit(float(start)), F.lit(float(step))
    guess = F.floor((a - s) / w)
    return F.when(a < s + guess * w, guess - 1).when(a >= s + (guess + 1) * w, guess + 1).otherwise(guess).cast("long")


def bin_centre(b="bin", start: float = FIRST_AGE, step: float = 1.0) -> Column:
    return F.lit(float(start)) + (c(b) + F.lit(0.5)) * F.lit(float(step))


def floor_bin(age="age") -> Column:
    return F.floor(c(age) - F.lit(FIRST_AGE)).cast("long")


def truncated_bin(age="age", lo: int = 1, hi: int = 21) -> Column:
    """Truncate toward zero, then clip."""
    return F.least(F.greatest(c(age).cast("long"), F.lit(lo)), F.lit(hi)).cast("long")


def height_slice(elev="elev", width: float = 250.0) -> Column:
    return F.floor(c(elev) / F.lit(width)).cast("long")


def band_of(value, bands: list[tuple[str, float, float]]) -> Column:
    """Label of the half-open band lo <= x < hi that holds the value, else NULL."""
    out = None
    for label, lo, hi in bands:
        hit = (c(value) >= F.lit(float(lo))) & (c(value) < F.lit(float(hi)))
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def histogram_bin(value, edges_from: float, width: float, n: int) -> Column:
    """Fixed-width bin index; the last bin also takes its right edge, values outside are NULL."""
    x, lo, hi = c(value), F.lit(float(edges_from)), F.lit(float(edges_from + n * width))
    guess = age_bin(x, edges_from, width)
    return F.when((x >= lo) & (x <= hi), F.least(guess, F.lit(n - 1))).cast("long")


def strata_rows(df: DataFrame, strata: list[tuple[str, Column]], name: str = "stratum") -> DataFrame:
    """One output row per stratum a row belongs to, in a single pass over the data."""
    labels = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(label)) for label, cond in strata])
    return df.withColumn(name, F.explode(F.filter(labels, lambda s: s.isNotNull())))


def long_measures(df: DataFrame, measures: list[str], name: str = "measure", value: str = "y") -> DataFrame:
    """Melt measure columns into (measure, y) rows, dropping missing values."""
    pairs = F.array(*[F.struct(F.lit(m).alias(name), F.col(m).alias(value)) for m in measures])
    keep = [x for x in df.columns if x not in measures]
    return df.select(*keep, F.inline(F.filter(pairs, lambda p: p[value].isNotNull())))


def common_support(df: DataFrame, group: Column, value: str) -> tuple[Column, Column]:
    """Shared range of the groups: (largest minimum, smallest maximum) as scalar subqueries."""
    ends = df.groupBy(group.alias("_g")).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return ends.agg(F.max("lo")).scalar(), ends.agg(F.min("hi")).scalar()


def grid_cell(lon, lat, west: float, north: float, size: float) -> tuple[Column, Column]:
    """(iy, ix) of a lon/lat point on a regular grid counted from the north-west corner."""
    return (
        F.floor((F.lit(north) - c(lat)) / F.lit(size)).cast("long"),
        F.floor((c(lon) - F.lit(west)) / F.lit(size)).cast("long"),
    )
