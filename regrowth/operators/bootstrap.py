"""Cluster bootstrap from per-unit sufficient statistics.

Drawing units with replacement equals giving each unit a count, so a replicate is a weighted sum of per-unit
sums and rows are never duplicated. Two schemes:

* multinomial: N draws out of N units per replicate, counts add up to N;
* poisson: an independent Poisson(1) count per unit and replicate.

Both run where the units' sums are (``replicates``): what is shuffled afterwards is a vector of B numbers per task and cell.
Draws come from md5 of the keys, so results do not depend on partitioning or retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from regrowth.functions.draws import poisson_count, uniform
from regrowth.operators.replicates import multinomial_table, replicate_sums
from regrowth.session import materialise

#: Replicates of the method's intervals by what they are for; every query takes its number from here.
REPLICATES = {"clocks": 300, "strata": 120, "event": 400, "within": 400, "bins": 200}


def _poisson_draws(unit: str, n_boot: int, seed: str):
    """Array of (rep, w) with w > 0. Draw first, count second: each draw is evaluated once."""
    reps = F.sequence(F.lit(1), F.lit(n_boot))
    draws = F.transform(reps, lambda rep: F.struct(rep.alias("rep"), uniform(F.lit(seed), F.col(unit), rep).alias("u")))
    counts = F.transform(draws, lambda d: F.struct(d["rep"].alias("rep"), poisson_count(d["u"]).alias("w")))
    return F.filter(counts, lambda c: c["w"] > 0)


def replicate_weights(units: DataFrame, unit: str, n_boot: int, seed: str, scheme: str = "multinomial") -> DataFrame:
    """(unit, rep, w) with w > 0 for each unit of ``units`` (distinct, one column)."""
    if scheme == "poisson":
        return units.select(unit).select(unit, F.inline(_poisson_draws(unit, n_boot, seed)))
    return multinomial_table(units, unit, n_boot, seed)


def unit_sums(df: DataFrame, unit: str, keys: list[str], value: str) -> DataFrame:
    """n, sum and sum of squares per unit and cell; the sufficient statistics of a mean and its SE."""
    y = F.col(value)
    return (
        df.where(y.isNotNull())
        .groupBy(unit, *keys)
        .agg(F.count(value).alias("n"), F.sum(y).alias("s1"), F.sum(y * y).alias("s2"))
    )


def _means(sums: DataFrame) -> DataFrame:
    """n, s1, s2 as n, mean and the SE that duplicated rows would give."""
    mean = F.col("s1") / F.col("n")
    var = (F.col("s2") - F.col("n") * mean * mean) / (F.col("n") - 1)
    rows = sums.withColumns({"n": F.col("n").cast("long"), "mean": mean, "se": F.when(F.col("n") > 1, F.sqrt(F.greatest(var, F.lit(0.0)) / F.col("n")))})
    return rows.drop("s1", "s2")


def weighted_cells(sums: DataFrame, weights: DataFrame, unit: str, keys: list[str]) -> DataFrame:
    """Replicate means with weights from a table; weights are combined before the shuffle."""
    w = F.col("w")
    rows = sums.join(weights, unit).groupBy("rep", *keys).agg(*[F.sum(w * F.col(s)).alias(s) for s in ("n", "s1", "s2")])
    return _means(rows)


def replicate_cells(sums: DataFrame, unit: str, keys: list[str], n_boot: int, seed: str, scheme: str) -> DataFrame:
    """Replicate means of cells: rep, keys, n, mean, se."""
    return _means(replicate_sums(sums, unit, keys, ["n", "s1", "s2"], n_boot, seed, scheme)).drop("draws", "n_units")


def poisson_cells(sums: DataFrame, unit: str, keys: list[str], n_boot: int, seed: str) -> DataFrame:
    """Replicate means with Poisson weights."""
    return replicate_cells(sums, unit, keys, n_boot, seed, "poisson")


def statistic(df: DataFrame, unit: str, keys: list[str], terms: dict[str, Column], value: Column, n_boot: int, seed: str, scheme: str = "multinomial") -> DataFrame:
    """An own statistic with its bootstrap interval by keys.

    ``terms`` are row expressions that are summed (a null counts as 0); ``value`` is any expression of the summed names. Returns
    keys, ``point`` and the columns of ``interval``.
    """
    named = {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in terms.items()}
    sums = materialise(df.groupBy(unit, *keys).agg(*[F.sum(v).alias(k) for k, v in named.items()]), "unit-terms")
    point = sums.groupBy(*keys).agg(*[F.sum(k).alias(k) for k in named]).select(*keys, value.alias("point"))
    reps = replicate_sums(sums, unit, keys, list(named), n_boot, seed, scheme).select("rep", *keys, value.alias("_value"))
    band = interval(reps, keys, "_value")
    return point.join(band, keys) if keys else point.crossJoin(band)  # one row each


def interval(df: DataFrame, keys: list[str], value: str, centre: float | None = 0.0, least: int = 1) -> DataFrame:
    """2.5 and 97.5 percentiles over replicates (a bounded number per cell), their mean and P(value > centre)."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(value).alias("n_boot"),
            F.avg(value).alias("boot_mean"),
            F.percentile(value, F.lit(0.025)).alias("lo"),
            F.percentile(value, F.lit(0.975)).alias("hi"),
            F.avg(F.when(F.col(value) > F.lit(centre), 1.0).otherwise(0.0)).alias("p_gt"),
        )
        .where(F.col("n_boot") >= least)
    )
