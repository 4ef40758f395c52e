"""Mergeable moments: n, means and centred cross products of a few columns, packed in one row per key.

Rows are read once. A table of moments answers for its rows from then on: parts of a key merge exactly, coefficients come from
the cross products, and the mean or variance of any linear combination (a residual, say) in any part follows without going back
to the rows. Sums are centred while they are built, so no shift of the whole table is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from regrowth.functions.small_math import solve_normal


class Moments:
    """Moments of ``cols``. In a table, ``n`` is long, ``mean`` has one number per column, ``cross`` the upper triangle by rows."""

    def __init__(self, cols: list[str]):
        self.cols = list(cols)
        self.pairs = [(a, b) for i, a in enumerate(self.cols) for b in self.cols[i:]]

    def table(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """One row per key; rows with a null in any of the columns are left out."""
        n = F.count(F.lit(1))
        cross = [(F.var_pop(a) if a == b else F.covar_pop(a, b)) * n for a, b in self.pairs]
        rows = df.dropna(subset=self.cols)
        return rows.groupBy(*keys).agg(n.alias("n"), F.array(*[F.avg(c) for c in self.cols]).alias("mean"), F.array(*cross).alias("cross"))

    def joined(self, a: Column, b: Column) -> Column:
        """Moments of two parts together (structs of n, mean, cross)."""
        n = a["n"] + b["n"]
        share = F.when(n > 0, b["n"] / n).otherwise(0.0)
        gap = {c: F.get(b["mean"], F.lit(i)) - F.get(a["mean"], F.lit(i)) for i, c in enumerate(self.cols)}
        mean = [F.get(a["mean"], F.lit(i)) + gap[c] * share for i, c in enumerate(self.cols)]
        cross = [F.get(a["cross"], F.lit(i)) + F.get(b["cross"], F.lit(i)) + gap[x] * gap[y] * a["n"] * share for i, (x, y) in enumerate(self.pairs)]
        return F.struct(n.alias("n"), F.array(*mean).alias("mean"), F.array(*cross).alias("cross"))

    def total(self, parts: Column) -> Column:
        """Moments of all structs of an array; few parts, as of the windows of a slice."""
        zero = lambda k: F.array(*[F.lit(0.0)] * k)
        none = F.struct(F.lit(0).cast("long").alias("n"), zero(len(self.cols)).alias("mean"), zero(len(self.pairs)).alias("cross"))
        return F.aggregate(parts, none, self.joined)

    def by_part(self, df: DataFrame, keys: list[str], part: Column) -> DataFrame:
        """One row per key with ``parts``: an array of (part, n, mean, cross). Two exchanges of keys x parts rows, one scan."""
        parts = self.table(df.withColumn("_part", part), [*keys, "_part"])
        return parts.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_part").alias("part"), "n", "mean", "cross")).alias("parts"))

    def mean(self, m: Column, c: str) -> Column:
        return F.get(m["mean"], F.lit(self.cols.index(c)))

    def cross(self, m: Column, a: str, b: str) -> Column:
        return F.get(m["cross"], F.lit(self.pairs.index((a, b) if (a, b) in self.pairs else (b, a))))

    def slopes(self, m: Column, y: str, xs: list[str]) -> Column:
        """Least-squares coefficients of y on xs as an array."""
        return solve_normal(F.array(*[self.cross(m, a, b) for a in xs for b in xs]), F.array(*[self.cross(m, a, y) for a in xs]))

    def mean_of(self, m: Column, weights: dict[str, Column]) -> Column:
        """Mean of a linear combination of the columns."""
        return reduce(lambda p, q: p + q, [w * self.mean(m, c) for c, w in weights.items()])

    def cross_of(self, m: Column, one: dict[str, Column], other: dict[str, Column]) -> Column:
        """Centred cross product of two linear combinations."""
        return reduce(lambda p, q: p + q, [v * w * self.cross(m, a, b) for a, v in one.items() for b, w in other.items()])

    def residual(self, b: Column, y: str, xs: list[str]) -> dict[str, Column]:
        """y less its fitted part, as a linear combination (not centred)."""
        return {y: F.lit(1.0)} | {x: -F.get(b, F.lit(i)) for i, x in enumerate(xs)}


def part_of(parts: Column, name: str) -> Column:
    """The part of that name in an array of parts; null where there is none."""
    return F.get(F.filter(parts, lambda p: p["part"] == name), F.lit(0))
