"""Leads and lags around the event with joint bootstrap intervals and pre-trend tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from regrowth.functions.columns import half_even
from regrowth.functions.small_math import chi2_tail, inverse_form
from regrowth.operators.bootstrap import interval, unit_sums
from regrowth.operators.replicates import replicate_sums
from regrowth.operators.reshape import net_of_reference, reference_lookup
from regrowth.session import materialise


def event_time_rows(long: DataFrame, unit: str, value: str, k_min: int = -7, k_max: int = 13) -> DataFrame:
    """beta = value minus the unit's reference value, per event time k; the reference period itself is dropped."""
    ref = reference_lookup(long, unit, value, F.col("is_pre"))
    rows = net_of_reference(long, ref, unit, value).withColumn("k", half_even("age"))
    return rows.where(F.col("k").between(k_min, k_max) & (F.col("k") != -1))


def event_time_sums(rows: DataFrame, unit: str, keys: list[str]) -> DataFrame:
    """Per-unit sums of beta for each k, written once: points, gates, units and replicates all read this."""
    return materialise(unit_sums(rows, unit, [*keys, "k"], "beta"), "event-time-sums")


def points_by_k(sums: DataFrame, unit: str, keys: list[str], min_n: int = 25) -> DataFrame:
    return (
        sums.groupBy(*keys, "k")
        .agg(F.sum("n").alias("n"), F.count_distinct(unit).alias("n_unit"), (F.sum("s1") / F.sum("n")).alias("beta"))
        .where(F.col("n") >= min_n)
    )


def replicate_curve(sums: DataFrame, unit: str, keys: list[str], n_boot: int, seed: str, min_n: int, scheme: str = "multinomial") -> DataFrame:
    """Mean beta per (rep, keys, k); one weight per unit and replicate serves every k, so replicates are joint. Units whose k are
    all thin still take their draws."""
    cells = points_by_k(sums, unit, keys, min_n).select(*keys, "k")
    reps = replicate_sums(sums, unit, [*keys, "k"], ["n", "s1"], n_boot, seed, scheme)
    return reps.join(cells, [*keys, "k"], "left_semi").select("rep", *keys, "k", (F.col("s1") / F.col("n")).alias("beta"))


def curve(rows: DataFrame, unit: str, keys: list[str], n_boot: int, seed: str, min_n: int = 25, scheme: str = "multinomial") -> DataFrame:
    """Mean beta by k with n, number of units and the bootstrap interval."""
    sums = event_time_sums(rows, unit, keys)
    reps = replicate_curve(sums, unit, keys, n_boot, seed, min_n, scheme)
    band = interval(reps, [*keys, "k"], "beta").select(*keys, "k", "lo", "hi", F.col("p_gt").alias("p_gt0"))
    return points_by_k(sums, unit, keys, min_n).join(band, [*keys, "k"])


def wald_of_leads(points: DataFrame, reps: DataFrame) -> DataFrame:
    """b' V^-1 b over the leads (k <= -2), V the replicate covariance, with its chi-square tail.

    Replicates are B x (number of leads) rows, whatever the size of the panel.
    """
    reps = materialise(reps.select("rep", "k", "beta"), "lead-replicates")  # read by both sides of the covariance
    leads = points.where(F.col("k") <= -2)
    n_leads = leads.agg(F.count(F.lit(1))).scalar()
    full = reps.join(leads.select("k"), "k", "left_semi").withColumn("_m", F.count(F.lit(1)).over(W.partitionBy("rep")))
    full = full.where(F.col("_m") == n_leads).select("rep", "k", "beta")
    other = full.select("rep", F.col("k").alias("k2"), F.col("beta").alias("beta2"))
    cov = full.join(other, "rep").groupBy("k", "k2").agg(F.covar_samp("beta", "beta2").alias("v"))
    matrix = cov.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "k2", "v"))), lambda x: x["v"])).scalar()
    b = leads.agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "beta"))), lambda x: x["beta"]).alias("b"), F.count(F.lit(1)).alias("df")
    )
    return b.withColumn("v", matrix).select("df", inverse_form("v", "b").alias("wald")).withColumn("p", chi2_tail("wald", "df"))


def pretrend_terms(curve_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Trend summaries of the leads: slope through the reference, free slope, largest step, adjusted first lag.

    Works on the point curve (keys = []) and on every replicate (keys = ['rep']).
    """
    groups = keys or ["_all"]
    rows = curve_rows if keys else curve_rows.withColumn("_all", F.lit(0))
    lead, x, b = F.col("k") <= -2, (F.col("k") + 1).cast("double"), F.col("beta")
    sums = rows.groupBy(*groups).agg(
        (F.sum(F.when(lead, x * b)) / F.sum(F.when(lead, x * x))).alias("slope_ref"),
        F.regr_slope(F.when(lead, b), F.when(lead, x)).alias("slope_free"),
        F.max(F.when(lead, F.abs(b))).alias("max_abs_lead"),
        F.sqrt(F.avg(F.when(lead, b * b))).alias("rms_lead"),
        F.min(F.when(F.col("k") >= 1, F.struct("k", "beta"))).alias("_first"),
    )
    # the reference period enters the path as zero at k = -1
    path = rows.where(lead).select(*groups, "k", "beta").unionByName(
        rows.select(*groups).distinct().withColumns({"k": F.lit(-1).cast("long"), "beta": F.lit(0.0)})
    )
    gap = F.abs(F.col("beta") - F.lag("beta").over(W.partitionBy(*groups).orderBy("k")))
    steps = path.withColumn("_gap", gap).groupBy(*groups).agg(F.max("_gap").alias("max_step"))
    span = F.col("_first.k") + 1
    out = sums.join(steps, groups).withColumns(
        {
            "k1": F.col("_first.k"),
            "jump1": F.col("_first.beta"),
            "adjusted_ref": F.col("_first.beta") - F.col("slope_ref") * span,
            "adjusted_free": F.col("_first.beta") - F.col("slope_free") * span,
        }
    )
    return out.drop("_first") if keys else out.drop("_first", "_all")


def identified_set(terms: DataFrame, mbars: list[float]) -> DataFrame:
    """beta_1 -/+ M * largest pre-event step, and the largest M that still excludes zero."""
    rows = terms.withColumn("mbar", F.explode(F.array(*[F.lit(float(m)) for m in mbars])))
    lo = F.col("jump1") - F.col("mbar") * F.col("max_step")
    hi = F.col("jump1") + F.col("mbar") * F.col("max_step")
    return rows.select(
        "mbar", lo.alias("lo"), hi.alias("hi"), ((lo > 0) | (hi < 0)).alias("excludes_zero"), (F.abs("jump1") / F.col("max_step")).alias("breakdown")
    )
