"""Grouped least squares on a few covariates, window contrasts and local slopes of short curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from regrowth.functions.small_math import t_two_sided
from regrowth.operators.moments import Moments, part_of


def grouped_ols(df: DataFrame, keys: list[str], y: str, xs: list[str], min_n: int = 0) -> DataFrame:
    """Per group: covariate means, y mean and slopes, from one pass of moments; rows with a null in one of them are left out."""
    m = Moments([y, *xs])
    g = m.table(df, keys).where(F.col("n") >= min_n).withColumn("_m", F.struct("n", "mean", "cross"))
    g = g.withColumn("_b", m.slopes(F.col("_m"), y, xs))
    means = [m.mean(F.col("_m"), v).alias(f"mean_{v}") for v in [y, *xs]]
    return g.select(*keys, "n", *means, *[F.get("_b", F.lit(i)).alias(f"b_{x}") for i, x in enumerate(xs)])


def residual_moments(df: DataFrame, keys: list[str], y: str, xs: list[str], against: str, min_n: int = 0, recentre: bool = False) -> DataFrame:
    """Per group the mean and root mean square of the residual of y on xs, and its line on ``against``: slope, intercept, r.

    All from one table of moments; ``recentre`` adds the group mean of y back to the residual.
    """
    m = Moments([y, *xs, against])
    g = m.table(df, keys).where(F.col("n") >= min_n).withColumn("_m", F.struct("n", "mean", "cross"))
    g = g.withColumn("_b", m.slopes(F.col("_m"), y, xs))
    res, other, one = m.residual(F.col("_b"), y, xs), {against: F.lit(1.0)}, F.col("_m")
    mean = m.mean(one, y) if recentre else F.lit(0.0)
    rr, rc, cc = m.cross_of(one, res, res), m.cross_of(one, res, other), m.cross(one, against, against)
    slope = rc / cc
    return g.select(
        *keys, "n", mean.alias("mean"), F.sqrt(rr / F.col("n") + mean * mean).alias("rms"),
        slope.alias("slope"), (mean - slope * m.mean(one, against)).alias("intercept"), (rc / F.sqrt(rr * cc)).alias("r"),
    )


def residual_windows(df: DataFrame, keys: list[str], y: str, models: dict[str, list[str]], x: str, lo: float, mid: float, hi: float, least: int, ddof: int, min_n: int = 0, scale: float = 2.0) -> DataFrame:
    """Per key and model: scale * (mean residual in [mid, hi) - mean residual in [lo, mid)) with its SE.

    A model names covariates of y; its residual is fitted in each key over all rows. One scan: the windows' moments are merged
    for the fits and then read apart.
    """
    covariates = list(dict.fromkeys(v for xs in models.values() for v in xs))
    m = Moments([y, *covariates])
    part = F.when((F.col(x) >= lo) & (F.col(x) < mid), "low").when((F.col(x) >= mid) & (F.col(x) < hi), "high").otherwise("rest")
    g = m.by_part(df, keys, part).withColumn("_m", m.total(F.col("parts")))
    g = g.withColumns({"n": F.col("_m.n"), "_low": part_of(F.col("parts"), "low"), "_high": part_of(F.col("parts"), "high")})
    g = g.where((F.col("n") >= min_n) & (F.col("_low.n") > least) & (F.col("_high.n") > least))
    out = []
    for name, xs in models.items():
        res = m.residual(m.slopes(F.col("_m"), y, xs), y, xs)
        side = {s: (m.mean_of(F.col(s), res), m.cross_of(F.col(s), res, res) / (F.col(f"{s}.n") - ddof) / F.col(f"{s}.n")) for s in ("_low", "_high")}
        out.append(F.struct(F.lit(name).alias("model"), ((side["_high"][0] - side["_low"][0]) * scale).alias("slope"), (F.sqrt(side["_high"][1] + side["_low"][1]) * scale).alias("se")))
    return g.select(*keys, "n", F.inline(F.array(*out)))


def residuals(df: DataFrame, keys: list[str], y: str, xs: list[str], min_n: int = 0, recentre: bool = False, out: str = "res") -> DataFrame:
    """y minus its grouped linear fit; with ``recentre`` the group mean of y is added back."""
    fit = grouped_ols(df, keys, y, xs, min_n).drop("n")
    rows = df.join(fit, keys)
    value = F.col(y) if recentre else F.col(y) - F.col(f"mean_{y}")
    for x in xs:
        value = value - F.col(f"b_{x}") * (F.col(x) - F.col(f"mean_{x}"))
    return rows.withColumn(out, value).drop(*[f"mean_{v}" for v in [y, *xs]], *[f"b_{x}" for x in xs])


def slope_with_se(df: DataFrame, keys: list[str], x: str, y: str, min_n: int = 3, p_value: bool = True) -> DataFrame:
    """Least-squares line with the slope's standard error and two-sided p."""
    g = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.regr_slope(F.col(y), F.col(x)).alias("slope"),
            F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
            F.corr(x, y).alias("r"),
            F.var_pop(x).alias("_vx"),
            F.var_pop(y).alias("_vy"),
        )
        .where(F.col("n") >= min_n)
    )
    se = F.sqrt((1 - F.col("r") * F.col("r")) * F.col("_vy") / F.col("_vx") / (F.col("n") - 2))
    g = g.withColumn("slope_se", se).drop("_vx", "_vy")
    return g.withColumn("p", t_two_sided(F.col("slope") / F.col("slope_se"), (F.col("n") - 2).cast("double"))) if p_value else g


def window_contrast(df: DataFrame, keys: list[str], x: str, y: str, lo: float, mid: float, hi: float, least: int, ddof: int, scale: float = 2.0) -> DataFrame:
    """scale * (mean of y in [mid, hi) - mean in [lo, mid)) with its SE; both windows need more than ``least`` rows."""
    a, b = (F.col(x) >= lo) & (F.col(x) < mid), (F.col(x) >= mid) & (F.col(x) < hi)
    var = F.var_samp if ddof else F.var_pop
    pick = lambda cond: F.when(cond, F.col(y))
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(pick(a)).alias("_na"), F.count(pick(b)).alias("_nb"),
        F.avg(pick(a)).alias("_ma"), F.avg(pick(b)).alias("_mb"), var(pick(a)).alias("_va"), var(pick(b)).alias("_vb"),
    )
    g = g.where((F.col("_na") > least) & (F.col("_nb") > least))
    se = F.sqrt(F.col("_va") / F.col("_na") + F.col("_vb") / F.col("_nb")) * scale
    return g.select(*keys, "n", ((F.col("_mb") - F.col("_ma")) * scale).alias("slope"), se.alias("se"))


def numeric_gradient(df: DataFrame, keys: list[str], x: str, y: str, name: str = "gradient") -> DataFrame:
    """Derivative of a short curve (one row per grid point): second-order inside, one-sided at the ends."""
    w = W.partitionBy(*keys).orderBy(x)
    px, py, nx, ny = F.lag(x).over(w), F.lag(y).over(w), F.lead(x).over(w), F.lead(y).over(w)
    left, right = F.col(x) - px, nx - F.col(x)
    inside = (left * left * ny + (right * right - left * left) * F.col(y) - right * right * py) / (left * right * (left + right))
    return df.withColumn(
        name, F.when(px.isNull(), (ny - F.col(y)) / right).when(nx.isNull(), (F.col(y) - py) / left).otherwise(inside)
    )


def interpolate(curve: DataFrame, keys: list[str], x: str, y: str, at: list[float]) -> DataFrame:
    """Piecewise-linear value of each (short) curve at the points ``at``; flat beyond the ends."""
    pts = curve.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("_p"))
    rows = pts.withColumn("x_at", F.explode(F.array(*[F.lit(float(v)) for v in at])))
    lo = F.element_at(F.filter("_p", lambda p: p["x"] <= F.col("x_at")), -1)
    hi = F.get(F.filter("_p", lambda p: p["x"] >= F.col("x_at")), F.lit(0))
    rows = rows.withColumns({"_lo": F.when(F.col("x_at") >= F.get("_p", F.lit(0))["x"], lo), "_hi": hi})
    value = (
        F.when(F.col("_lo").isNull(), F.col("_hi.y"))
        .when(F.col("_hi").isNull() | (F.col("_hi.x") == F.col("_lo.x")), F.col("_lo.y"))
        .otherwise(F.col("_lo.y") + (F.col("_hi.y") - F.col("_lo.y")) * (F.col("x_at") - F.col("_lo.x")) / (F.col("_hi.x") - F.col("_lo.x")))
    )
    return rows.select(*keys, "x_at", value.alias("value"))


def first_where(curve: DataFrame, keys: list[str], x: str, cond: Column, name: str = "first_x") -> DataFrame:
    return curve.groupBy(*keys).agg(F.min(F.when(cond, F.col(x))).alias(name))


def unit_slopes(df: DataFrame, unit: str, x: str, y: str, keep: list[str]) -> DataFrame:
    """Per unit with at least two values: slope of y on x, mean x, mean y."""
    g = df.where(F.col(y).isNotNull()).groupBy(unit, *keep).agg(
        F.count(F.lit(1)).alias("_n"), F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y")
    )
    return g.where((F.col("_n") >= 2) & F.col("slope").isNotNull()).drop("_n")


def implied_tau(slopes: DataFrame, keys: list[str], growing: bool, min_n: int = 10) -> DataFrame:
    """tau = -mean level / mean slope with a delta-method SE, only where the slope points back to zero."""
    g = slopes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("slope").alias("slope"),
        (F.stddev_samp("slope") / F.sqrt(F.count(F.lit(1)))).alias("slope_se"),
        F.avg("mean_y").alias("level"),
        (F.stddev_samp("mean_y") / F.sqrt(F.count(F.lit(1)))).alias("_level_se"),
    ).where(F.col("n") >= min_n)
    ok = F.col("slope") > 0 if growing else F.col("slope") < 0
    tau = F.when(ok, -F.col("level") / F.col("slope"))
    spread = F.sqrt(F.pow(F.col("_level_se") / F.col("level"), 2.0) + F.pow(F.col("slope_se") / F.col("slope"), 2.0))
    return g.withColumns({"tau": tau, "tau_se": F.abs(tau) * spread}).drop("_level_se")
