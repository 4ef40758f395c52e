"""Within-unit estimators from per-unit sums; no unit's rows are ever gathered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from regrowth.functions.small_math import solve_normal
from regrowth.operators.moments import Moments
from regrowth.operators.replicates import replicate_sums
from regrowth.session import materialise

MIN_OBS, MIN_SPAN = 4, 4.0  # fixed values: observations and years a unit must cover


def long_enough(df: DataFrame, unit: str, age: str = "age", least: int = MIN_OBS, span: float = MIN_SPAN) -> DataFrame:
    """Rows of units with at least ``least`` observations over at least ``span`` years."""
    keep = df.groupBy(unit).agg(F.count(F.lit(1)).alias("_n"), (F.max(age) - F.min(age)).alias("_span"))
    return df.join(keep.where((F.col("_n") >= least) & (F.col("_span") >= span)), unit, "left_semi")


def within_demean(df: DataFrame, unit: str, columns: list[str]) -> DataFrame:
    """Subtract the unit mean: partial aggregation plus a join, so a hot unit is split, not gathered."""
    means = df.groupBy(unit).agg(*[F.avg(x).alias(f"_m_{x}") for x in columns])
    return df.join(means, unit).withColumns({f"{x}_w": F.col(x) - F.col(f"_m_{x}") for x in columns}).drop(*[f"_m_{x}" for x in columns])


def unit_cross_sums(df: DataFrame, unit: str, y: str, x: str) -> DataFrame:
    """Per unit: n, Sxy and Sxx about the unit means (all that the within slope needs)."""
    return df.groupBy(unit).agg(
        F.count(F.lit(1)).alias("n"),
        (F.covar_pop(y, x) * F.count(F.lit(1))).alias("sxy"),
        (F.var_pop(x) * F.count(F.lit(1))).alias("sxx"),
    )


def within_slope(sums: DataFrame) -> DataFrame:
    return sums.agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_units"), (F.sum("sxy") / F.sum("sxx")).alias("beta")
    )


def tau_grid(lo: float = 1.0, hi: float = 60.0, step: float = 0.25) -> list[float]:
    return [lo + i * step for i in range(int(round((hi - lo) / step)) + 1)]


#: Places of a unit's vector before its costs: rows, Sgy, Sgg, Say, Saa about the unit means (g = exp(-age / tau), a = age).
WITHIN = ("n", "sgy", "sgg", "say", "saa")


def unit_vectors(df: DataFrame, unit: str, y: str, age: str, taus: list[float], shape_tau: Column | float = 1.0) -> DataFrame:
    """(unit, v): the within-unit sums named in ``WITHIN``, then for every tau the squared error with a free amplitude,
    Syy - Syw^2 / Sww with w = exp(-age / tau).

    Rows of one age are added up first, so a unit is as many numbers as it has different ages, however many rows it has.
    """
    yv = F.col(y)
    ages = df.where(yv.isNotNull()).groupBy(unit, F.col(age).cast("double").alias("a")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(yv).alias("s"), F.sum(yv * yv).alias("q"))
    units = ages.groupBy(unit).agg(F.sort_array(F.collect_list(F.struct("a", "n", "s", "q"))).alias("_p"))
    units = units.withColumn("_t", F.lit(shape_tau) if isinstance(shape_tau, float) else shape_tau)
    kind, grid = df.schema[unit].dataType, np.array(taus)
    schema = T.StructType([T.StructField(unit, kind), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for points, tau in zip(batch.column("_p").to_pylist(), batch.column("_t").to_pylist(), strict=True):
                a, n, s, q = (np.array([p[k] for p in points]) for k in ("a", "n", "s", "q"))
                g, total = np.exp(-a / tau), n.sum()
                gw, aw, yw = g - n @ g / total, a - n @ a / total, s - n * (s.sum() / total)
                w = np.exp(-a[:, None] / grid)
                num, den = s @ w, n @ (w * w)
                cost = q.sum() - np.where(den > 1e-12, num * num / np.maximum(den, 1e-12), 0.0)
                out.append(np.concatenate([[total, yw @ gw, n @ (gw * gw), yw @ aw, n @ (aw * aw)], cost]))
            yield pa.RecordBatch.from_arrays([batch.column(unit), pa.array(out, pa.list_(pa.float64()))], [unit, "v"])

    return units.mapInArrow(run, schema)


def vector_total(units: DataFrame, v: str = "v") -> DataFrame:
    """One row: the arrays added up element by element, combined in each task before the shuffle."""
    sums = units.select(F.posexplode(v).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    return sums.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias(v))


def best_tau(costs: Column, taus: list[float]) -> Column:
    """The tau of the least cost (to nine digits); ties go to the smallest."""
    pairs = F.zip_with(costs, F.array(*[F.lit(t) for t in taus]), lambda c, t: F.struct(F.round(c, 9).alias("c"), t.alias("t")))
    return F.array_min(pairs)["t"]


def tau_by_grid(df: DataFrame, unit: str, y: str, age: str, lo: float = 1.0, hi: float = 60.0, step: float = 0.25) -> DataFrame:
    """tau that minimises the squared error with a free amplitude per unit, and that error."""
    taus = tau_grid(lo, hi, step)
    costs = vector_total(unit_vectors(df, unit, y, age, taus)).select(F.slice("v", len(WITHIN) + 1, len(taus)).alias("c")).where(F.size("c") > 0)
    return costs.select(best_tau(F.col("c"), taus).alias("tau_fe"), F.array_min("c").alias("ssr"))


def within_intervals(df: DataFrame, unit: str, y: str, age: str, clock: DataFrame, n_boot: int, n_boot_tau: int, seed: str) -> DataFrame:
    """Within-unit share of the pooled curve, slope in age and tau, each with its bootstrap interval over units; one row.

    ``clock`` is one row (tau, amp) of the pooled fit. Shape slopes and costs of a replicate are weighted sums of the units'
    vectors; tau is searched in steps of 0.25 for the point and 0.5 for the first ``n_boot_tau`` replicates.
    """
    taus, k = tau_grid(), len(WITHIN)
    clock = materialise(clock.select("tau", "amp"), "clock")
    tau, amp = clock.select("tau").scalar(), clock.select("amp").scalar()
    units = materialise(unit_vectors(df, unit, y, age, taus, tau), "unit-vectors")
    at = lambda name: F.get("v", F.lit(WITHIN.index(name)))
    costs = F.slice("v", k + 1, len(taus))
    pooled_slope = df.where(F.col(y).isNotNull()).select(F.avg(-amp / tau * F.exp(-F.col(age) / tau))).scalar()
    point = vector_total(units).select(
        at("n").cast("long").alias("n_rows"), (at("sgy") / at("sgg")).alias("beta"), (at("say") / at("saa")).alias("slope"), best_tau(costs, taus).alias("tau_fe"))
    coarse = F.filter(costs, lambda c, i: i % 2 == 0)
    reps = replicate_sums(units, unit, [], ["v"], n_boot, seed).select(
        (at("sgy") / at("sgg")).alias("beta"), (at("say") / at("saa")).alias("slope"), F.when(F.col("rep") <= n_boot_tau, best_tau(coarse, taus[::2])).alias("tau"))
    q = lambda c, p, name: F.percentile(c, F.lit(p)).alias(name)
    band = reps.agg(
        F.count("beta").alias("n_boot"), q("beta", 0.025, "beta_lo"), q("beta", 0.975, "beta_hi"), q("slope", 0.025, "slope_lo"), q("slope", 0.975, "slope_hi"),
        q("tau", 0.025, "tau_lo"), q("tau", 0.975, "tau_hi"), F.count("tau").alias("n_boot_tau"), F.avg((F.signum("beta") == F.signum(amp)).cast("double")).alias("p_same_sign"),
    )
    rows = point.withColumn("_b", band.select(F.struct("*")).scalar()).withColumns({"n_units": units.select(F.count(F.lit(1))).scalar(), "tau_pooled": tau, "amp_pooled": amp, "pooled_slope": pooled_slope})
    rows = rows.select(*rows.drop("_b").columns, "_b.*").where(F.col("n_rows").isNotNull())
    return rows.withColumns({"frac": F.col("beta") / F.col("amp_pooled"), "frac_lo": F.col("beta_lo") / F.col("amp_pooled"), "frac_hi": F.col("beta_hi") / F.col("amp_pooled")})


def listed(period: str, periods: list[str]):
    """0.0 for a listed period; any other stops the query, because it would count as the base period."""
    message = F.concat(F.lit("period not listed: "), F.coalesce(F.col(period).cast("string"), F.lit("null")))
    return F.when(F.col(period).isin(periods), F.lit(0.0)).otherwise(F.raise_error(message).cast("double"))


def unit_period_moments(df: DataFrame, unit: str, period: str, columns: list[str], periods: list[str]) -> DataFrame:
    """Per unit: n, ``mean`` and centred ``cross`` of the columns (upper triangle), and for each period but the first how often
    it occurs (``seen``) and the columns' sums in it (``in_<column>``). Period effects need no dummy columns beyond these."""
    m = Moments(columns)
    df = df.withColumn(columns[0], F.col(columns[0]) + listed(period, periods)).dropna(subset=columns)
    at = [F.col(period) == p for p in periods[1:]]
    n = F.count(F.lit(1))
    cross = [(F.var_pop(a) if a == b else F.covar_pop(a, b)) * n for a, b in m.pairs]
    sums = [F.array(*[F.sum(F.when(c, F.col(v)).otherwise(0.0)) for c in at]).alias(f"in_{v}") for v in columns]
    return df.groupBy(unit).agg(
        n.alias("n"), F.array(*[F.avg(v) for v in columns]).alias("mean"), F.array(*cross).alias("cross"),
        F.array(*[F.sum(F.when(c, 1.0).otherwise(0.0)) for c in at]).alias("seen"), *sums,
    )


def period_normal(units: DataFrame, columns: list[str], n_periods: int) -> DataFrame:
    """One row: n_rows, ``cross`` of the columns within units, and the period dummies' cross products within units with each other
    (``dd``, row-major) and with each column (``d_<column>``). A unit adds to each, so its rows are never met again."""
    k = n_periods - 1
    seen = lambda i: F.get("seen", F.lit(i))
    half = {(i, j): F.sum((seen(i) if i == j else F.lit(0.0)) - seen(i) * seen(j) / F.col("n")) for i in range(k) for j in range(i, k)}
    dd = [half[min(i, j), max(i, j)] for i in range(k) for j in range(k)]
    with_columns = [
        F.array(*[F.sum(F.get(f"in_{v}", F.lit(i)) - seen(i) * F.get("mean", F.lit(c))) for i in range(k)]).alias(f"d_{v}") for c, v in enumerate(columns)
    ]
    pairs = len(columns) * (len(columns) + 1) // 2
    cross = F.array(*[F.sum(F.get("cross", F.lit(i))) for i in range(pairs)])
    return units.agg(F.sum("n").alias("n_rows"), cross.alias("cross"), F.array(*dd).alias("dd"), *with_columns)


def two_way(df: DataFrame, unit: str, period: str, y: str, x: str, periods: list[str]) -> DataFrame:
    """Slope on x with unit and period effects, and the share of x's within-unit variation that is left.

    From one row of moments per unit; the period dummies are then eliminated through their cross products within units, which is
    the exact limit of alternating demeaning. The first period is the base.
    """
    m = Moments([y, x])
    sums = period_normal(unit_period_moments(df, unit, period, [y, x], periods), [y, x], len(periods))
    sums = sums.withColumn("cg", solve_normal("dd", f"d_{x}"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    one = F.struct("cross")
    gg, gy = m.cross(one, x, x), m.cross(one, x, y)
    left = gg - dot("cg", f"d_{x}")
    return sums.select("n_rows", (gy / gg).alias("beta_unit"), ((gy - dot("cg", f"d_{y}")) / left).alias("beta_two_way"), (left / gg).alias("share_left"))


def two_way_demean(df: DataFrame, unit: str, period: str, columns: list[str], periods: list[str]) -> DataFrame:
    """Rows with unit and period means swept out of ``columns`` (suffix _tw), without alternating passes.

    A swept value is the value less its period's effect less one number of its unit and column, so the rows meet only those.
    """
    units = unit_period_moments(df, unit, period, columns, periods)
    effects = period_normal(units, columns, len(periods)).select(F.struct(*[solve_normal("dd", f"d_{v}").alias(v) for v in columns])).scalar()
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    own = units.withColumn("_e", effects).select(
        unit, *[(F.get("mean", F.lit(i)) - dot(F.col(f"_e.{v}"), F.col("seen")) / F.col("n")).alias(f"_u_{v}") for i, v in enumerate(columns)])
    out = df.withColumn(columns[0], F.col(columns[0]) + listed(period, periods)).join(own, unit).withColumn("_e", effects)
    for v in columns:
        effect = F.lit(0.0)
        for i, p in enumerate(periods[1:]):
            effect = F.when(F.col(period) == p, F.get(F.col(f"_e.{v}"), F.lit(i))).otherwise(effect)
        out = out.withColumn(f"{v}_tw", F.col(v) - effect - F.col(f"_u_{v}"))
    return out.drop("_e", *[f"_u_{v}" for v in columns])


def slope_given_bins(df: DataFrame, bins: str, y: str, x: str) -> DataFrame:
    """Coefficient of x in y ~ bin dummies + x: the within-bin slope."""
    sums = df.groupBy(bins).agg(
        F.count(F.lit(1)).alias("n"), (F.covar_pop(y, x) * F.count(F.lit(1))).alias("sxy"), (F.var_pop(x) * F.count(F.lit(1))).alias("sxx")
    )
    return sums.agg(F.sum("n").alias("n_rows"), (F.sum("sxy") / F.sum("sxx")).alias("beta"))


def cross_sums(df: DataFrame, unit: str, bins: str, y: str, x: str) -> DataFrame:
    """Per-(unit, bin) sums for the replicates; y and x should be roughly centred."""
    return df.groupBy(unit, bins).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(x).alias("sx"),
        F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(x) * F.col(x)).alias("sxx"),
    )


def bootstrap_slope_given_bins(sums: DataFrame, unit: str, bins: str, n_boot: int, seed: str, scheme: str = "poisson") -> DataFrame:
    """The within-bin slope of every replicate."""
    cells = replicate_sums(sums, unit, [bins], ["n", "sy", "sx", "sxy", "sxx"], n_boot, seed, scheme)
    num = F.sum(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"))
    den = F.sum(F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"))
    return cells.groupBy("rep").agg((num / den).alias("beta"))
