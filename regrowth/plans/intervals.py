"""Queries for intervals and second measures: shares, ratios, severity, eras, net anomalies, event studies, cohort strata.

Gates on units and rows are arguments; where the small fixture needs a lower one than the method's, the query says so.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from regrowth.operators import aggregate as ag
from regrowth.operators import binning as bn
from regrowth.operators import bootstrap as bt
from regrowth.operators import event_study as es
from regrowth.operators import fitting as ft
from regrowth.operators import quantiles as qt
from regrowth.operators import reshape as rs
from regrowth.operators import spatial as sp
from regrowth.functions import columns as fc
from regrowth.plans import fixtures as fx
from regrowth.plans.effects import AREA, BANDS, ELEV, ES, KG, REPS, es_points_and_reps, es_rows
from regrowth.plans.recovery import EV, L, NETA, boot_bins, event_post, multinomial_sql, poisson_sql
from regrowth.plans.registry import n, query, r
from regrowth.plans.sources_and_panel import strata_sql, usual_strata
from regrowth.plans.sql_fit import MELT
from regrowth.plans.sql_fit import fit_sql
from regrowth.session import materialise

B = bt.REPLICATES
G = f"WITH {fx.GRID_SQL}\n"


def quant(expr: str, p: float, alias: str, digits: int = 2) -> str:
    return r(f"quantile_cont({expr}, {p})", alias, digits)


def replicate_fits(rows, keys: list[str], n_boot: int, seed: str):
    """Fits of every replicate by keys and measure; rows hold ``bin`` and both measures."""
    sums = bt.unit_sums(bn.long_measures(rows, ["dlst", "dndvi"]), "pid", [*keys, "measure", "bin"], "y")
    cells = bt.poisson_cells(sums, "pid", [*keys, "measure", "bin"], n_boot, seed).withColumn("centre", bn.bin_centre())
    return ft.fit_bins(cells, ["rep", *keys, "measure"])


def replicate_sql(source: str, keys: str, n_boot: int, seed: str) -> str:
    """CTEs ending in ``f``(rep, keys, measure, tau, amp) from rows (pid, keys, measure, bin, y) of ``source``."""
    return (
        f"us AS (SELECT pid, {keys}, measure, bin, count(*) AS n, sum(y) AS s1, sum(y * y) AS s2 FROM {source} GROUP BY ALL),\n"
        + poisson_sql("SELECT DISTINCT pid FROM us", "pid", n_boot, seed) + ",\n" + fit_sql(boot_bins(f"{keys}, measure, bin"), f"rep, {keys}, measure", "f")
    )


AGES = [5.0, 10.0, 15.0, 20.0]
SHARE = "100 * (1 - exp(-at_age / tau))"
STRATA_BOOT = L + ", " + MELT + f", st AS ({strata_sql('ml')}), " + replicate_sql("st", "stratum", B["strata"], "d")


def strata_replicates(spark, sf):
    rows = bn.strata_rows(fx.post_panel(spark, sf).withColumn("bin", bn.age_bin()), usual_strata())
    return replicate_fits(rows, ["stratum"], B["strata"], "d")


@query("dissipated_ci", STRATA_BOOT + f", a AS (SELECT unnest({AGES}::DOUBLE[]) AS at_age) SELECT stratum, measure, {r('at_age', 'at_age')}, {n('count(*)', 'n_boot')}, {quant(SHARE, 0.025, 'lo')}, {quant(SHARE, 0.975, 'hi')} FROM f, a GROUP BY stratum, measure, at_age", 2)
def _(spark, sf):
    """Intervals of the dissipated share, both measures."""
    f = ft.dissipated(strata_replicates(spark, sf), AGES)
    return f.groupBy("stratum", "measure", "at_age").agg(
        F.count(F.lit(1)).alias("n_boot"), F.percentile("dissipated_pct", F.lit(0.025)).alias("lo"), F.percentile("dissipated_pct", F.lit(0.975)).alias("hi")
    )


PAIRED = ", pr AS (SELECT rep, {k}, max(tau) FILTER (measure = 'dlst') / max(tau) FILTER (measure = 'dndvi') AS ratio FROM f GROUP BY ALL)"


def ratios(fits, keys):
    pick = lambda m: F.max(F.when(F.col("measure") == m, F.col("tau")))
    return fits.groupBy("rep", *keys).agg((pick("dlst") / pick("dndvi")).alias("ratio")).where(F.col("ratio").isNotNull())


@query("tau_ratio_ci", STRATA_BOOT + PAIRED.format(k="stratum") + f" SELECT stratum, {n('count(*)', 'n_boot')}, {quant('ratio', 0.025, 'lo')}, {quant('ratio', 0.975, 'hi')} FROM pr WHERE ratio IS NOT NULL GROUP BY 1", 2)
def _(spark, sf):
    """Intervals of the ratio of the two clocks, by stratum."""
    return bt.interval(ratios(strata_replicates(spark, sf), ["stratum"]), ["stratum"], "ratio").select("stratum", "n_boot", "lo", "hi")


SEVERITY = [("severe", -1.0, -0.30), ("high", -0.30, -0.20), ("moderate", -0.20, -0.12), ("light", -0.12, 0.0)]  # fixed values
SEV_SQL = """, sev AS (SELECT pid, avg(dndvi) AS sev FROM post WHERE age >= 0.6 AND age < 3.0 GROUP BY 1),
s0 AS (SELECT CASE WHEN src = 'event' THEN 'landslide' ELSE 'annual_loss' END AS cls, CASE """ + " ".join(f"WHEN sev >= {lo} AND sev < {hi} THEN '{k}'" for k, lo, hi in SEVERITY) + """ END AS severity, post.* FROM post JOIN sev USING (pid)),
sg AS (SELECT severity, cls, pid, bin, 'dlst' AS measure, dlst AS y FROM s0 JOIN (SELECT severity, cls FROM s0 WHERE severity IS NOT NULL GROUP BY ALL HAVING count(DISTINCT pid) >= {least}) USING (severity, cls) WHERE dlst IS NOT NULL),
"""


def severity_rows(spark, sf, least: int = 60):
    p = fx.post_panel(spark, sf)
    sev = p.where((F.col("age") >= 0.6) & (F.col("age") < 3.0)).groupBy("pid").agg(F.avg("dndvi").alias("sev"))
    cls = F.when(F.col("src") == "event", "landslide").otherwise("annual_loss")
    rows = p.join(sev, "pid").withColumns({"cls": cls, "severity": bn.band_of("sev", SEVERITY), "bin": bn.age_bin()}).where(F.col("severity").isNotNull())
    enough = rows.groupBy("severity", "cls").agg(F.count_distinct("pid").alias("u")).where(F.col("u") >= least)
    return rows.join(enough, ["severity", "cls"], "left_semi").withColumn("dndvi", F.lit(None).cast("double"))


@query(
    "severity_match_ci",
    L + SEV_SQL.format(least=60) + replicate_sql("sg", "severity, cls", B["strata"], "v")
    + f", w AS (SELECT rep, severity, max(tau) FILTER (cls = 'landslide') AS a, max(tau) FILTER (cls = 'annual_loss') AS b FROM f GROUP BY 1, 2), z AS (SELECT severity, cls AS what, tau AS v FROM f UNION ALL SELECT severity, 'ratio', a / b FROM w WHERE a IS NOT NULL AND b IS NOT NULL)"
    + f" SELECT severity, what, {n('count(*)', 'n_boot')}, {quant('v', 0.025, 'lo')}, {quant('v', 0.975, 'hi')} FROM z GROUP BY 1, 2",
    2,
)
def _(spark, sf):
    """Four severity bins, both classes and their ratio."""
    f = materialise(replicate_fits(severity_rows(spark, sf), ["severity", "cls"], B["strata"], "v"), "severity-fits")
    pick = lambda c: F.max(F.when(F.col("cls") == c, F.col("tau")))
    ratio = f.groupBy("rep", "severity").agg((pick("landslide") / pick("annual_loss")).alias("v")).where(F.col("v").isNotNull())
    both = f.select("severity", F.col("cls").alias("what"), F.col("tau").alias("v")).unionByName(ratio.select("severity", F.lit("ratio").alias("what"), "v"))
    return bt.interval(both, ["severity", "what"], "v").select("severity", "what", "n_boot", "lo", "hi")


ERA_SQL = """, g AS (SELECT yr <= 1998 AS early, min(age) AS lo, max(age) AS hi FROM ev GROUP BY 1), cw AS (SELECT max(lo) AS lo, min(hi) AS hi FROM g),
er AS (SELECT 'all' AS part, * FROM ev UNION ALL SELECT 'early', * FROM ev WHERE yr <= 1998 UNION ALL SELECT 'late', * FROM ev WHERE yr > 1998
  UNION ALL SELECT 'all_common', ev.* FROM ev, cw WHERE age BETWEEN cw.lo AND cw.hi UNION ALL SELECT 'early_common', ev.* FROM ev, cw WHERE yr <= 1998 AND age BETWEEN cw.lo AND cw.hi
  UNION ALL SELECT 'late_common', ev.* FROM ev, cw WHERE yr > 1998 AND age BETWEEN cw.lo AND cw.hi)"""


def era_rows(spark, sf):
    ev = event_post(spark, sf).withColumn("bin", bn.age_bin())
    early = F.col("yr") <= 1998
    lo, hi = bn.common_support(ev, early, "age")
    ev = ev.withColumns({"_lo": lo, "_hi": hi})
    shared = (F.col("age") >= F.col("_lo")) & (F.col("age") <= F.col("_hi"))
    parts = [("all", F.lit(True)), ("early", early), ("late", ~early), ("all_common", shared), ("early_common", early & shared), ("late_common", ~early & shared)]
    return bn.strata_rows(ev, parts, "part")


@query(
    "era_compare_ci",
    L + EV + ERA_SQL + ", em AS (SELECT part, pid, bin, 'dlst' AS measure, dlst AS y FROM er WHERE dlst IS NOT NULL UNION ALL SELECT part, pid, bin, 'dndvi', dndvi FROM er WHERE dndvi IS NOT NULL), "
    + replicate_sql("em", "part", B["strata"], "y") + f" SELECT part, measure, {n('count(*)', 'n_boot')}, {quant('tau', 0.025, 'lo')}, {quant('tau', 0.975, 'hi')} FROM f GROUP BY 1, 2 HAVING count(*) > 20",
    2,
)
def _(spark, sf):
    f = replicate_fits(era_rows(spark, sf), ["part"], B["strata"], "y")
    return bt.interval(f, ["part", "measure"], "tau", least=21).select("part", "measure", "n_boot", "lo", "hi")


@query("era_profile", L + EV + ERA_SQL + f" SELECT part, {n('count(*)', 'n_rows')}, {n('count(DISTINCT pid)', 'n_units')}, {r('median(elev)', 'elev_med')}, {r('median(area_ha)', 'area_med')}, {r('min(age)', 'age_lo')}, {r('max(age)', 'age_hi')} FROM er GROUP BY 1")
def _(spark, sf):
    rows = era_rows(spark, sf)
    out = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("pid").alias("n_units"), F.min("age").alias("age_lo"), F.max("age").alias("age_hi"))
    return out.join(qt.medians(rows, ["part"], "elev", "elev_med"), "part").join(qt.medians(rows, ["part"], "area_ha", "area_med"), "part")


# ---------------- net anomaly ----------------


def net_rows(spark, sf):
    lp = fx.long_panel(spark, sf).where((F.col("src") == "event") & F.col("clean"))
    heat = rs.pre_mean(lp, "pid", "dlst", F.col("is_pre")).withColumnRenamed("reference", "_t")
    green = rs.pre_mean(lp, "pid", "dndvi", F.col("is_pre")).withColumnRenamed("reference", "_g")
    rows = lp.where(fc.after_event()).join(heat, "pid").join(green, "pid", "left")
    return rows.withColumns({"dlst_net": F.col("dlst") - F.col("_t"), "dndvi_net": F.col("dndvi") - F.col("_g"), "bin": bn.floor_bin()})


NET_SQL = EV + """, pre AS (SELECT pid, avg(dlst) AS t, avg(dndvi) AS g FROM lp WHERE is_pre AND clean AND src = 'event' GROUP BY 1 HAVING count(dlst) > 0),
nr AS (SELECT ev.* EXCLUDE (bin), CAST(floor(age - 0.6::DOUBLE) AS BIGINT) AS bin, dlst - t AS dlst_net, dndvi - g AS dndvi_net FROM ev JOIN pre USING (pid)),
nm AS (SELECT year, pid, bin, 'dlst_net' AS measure, dlst_net AS y FROM nr WHERE dlst_net IS NOT NULL UNION ALL SELECT year, pid, bin, 'dndvi_net', dndvi_net FROM nr WHERE dndvi_net IS NOT NULL)"""


def net_measures(spark, sf):
    return bn.long_measures(net_rows(spark, sf), ["dlst_net", "dndvi_net"])


@query("net_anomaly_cohort", L + NET_SQL + f" SELECT CAST(year AS VARCHAR) AS cohort, measure, {n('bin', 'bin')}, {n('count(*)', 'n')}, {r('avg(y)', 'mean')} FROM nm GROUP BY year, measure, bin HAVING count(*) >= 12 UNION ALL SELECT 'all', measure, {n('bin', 'bin')}, {n('count(*)', 'n')}, {r('avg(y)', 'mean')} FROM nm GROUP BY measure, bin HAVING count(*) >= 12")
def _(spark, sf):
    """Series of each cohort and of all, both measures."""
    rows = net_measures(spark, sf).withColumn("cohort", F.explode(F.array(F.lit("all"), F.col("year").cast("string"))))
    return rows.groupBy("cohort", "measure", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean")).where(F.col("n") >= 12)


NET_CELLS = ", us AS (SELECT pid, measure, bin, count(*) AS n, sum(y) AS s FROM nm GROUP BY ALL),\n" + poisson_sql("SELECT DISTINCT pid FROM us", "pid", B["event"], "n") + ", cb AS (SELECT rep, measure, bin, sum(w * s) / sum(w * n) AS mean, sum(w * n) AS n FROM us JOIN wt USING (pid) GROUP BY 1, 2, 3 HAVING sum(w * n) >= 12)"


def net_replicates(spark, sf):
    # two queries' branches read the replicates
    cells = bt.poisson_cells(bt.unit_sums(net_measures(spark, sf), "pid", ["measure", "bin"], "y"), "pid", ["measure", "bin"], B["event"], "n")
    return materialise(cells.where(F.col("n") >= 12), "net-replicates")


@query("net_anomaly_ci", L + NET_SQL + NET_CELLS + f" SELECT measure, {n('bin', 'bin')}, {n('count(*)', 'n_boot')}, {quant('mean', 0.025, 'lo', 5)}, {quant('mean', 0.975, 'hi', 5)} FROM cb GROUP BY 1, 2 HAVING count(*) >= 100", 5)
def _(spark, sf):
    return bt.interval(net_replicates(spark, sf), ["measure", "bin"], "mean", least=100).select("measure", "bin", "n_boot", "lo", "hi")


@query("net_anomaly_share_ci", L + NET_SQL + NET_CELLS + f", s AS (SELECT rep, measure, a.bin, 100 * (1 - a.mean / b.mean) AS pct FROM cb a JOIN cb b USING (rep, measure) WHERE b.bin = 0 AND a.bin > 0) SELECT measure, {n('bin', 'bin')}, {n('count(*)', 'n_boot')}, {quant('pct', 0.025, 'lo', 4)}, {quant('pct', 0.975, 'hi', 4)} FROM s GROUP BY 1, 2 HAVING count(*) >= 100", 4)
def _(spark, sf):
    """Dissipated share of the first bin's net anomaly, with its interval, for every later bin (ten years: bin 9)."""
    cells = net_replicates(spark, sf)
    first = cells.where(F.col("bin") == 0).select("rep", "measure", F.col("mean").alias("_first"))
    rows = cells.where(F.col("bin") > 0).join(first, ["rep", "measure"]).withColumn("pct", 100 * (1 - F.col("mean") / F.col("_first")))
    return bt.interval(rows, ["measure", "bin"], "pct", least=100).select("measure", "bin", "n_boot", "lo", "hi")


# ---------------- event study, cohorts, mosaic ----------------


@query(
    "pretrend_covariance",
    L + ES + KG + REPS + f", rk AS (SELECT * FROM rp WHERE k IN (SELECT k FROM pt WHERE n >= 25)) SELECT {n('a.k', 'k')}, {n('b.k', 'k2')}, {r('covar_samp(a.beta, b.beta)', 'cov', 9)} FROM rk a JOIN rk b USING (rep) GROUP BY a.k, b.k",
    9,
)
def _(spark, sf):
    """Covariance of all leads and lags over the joint replicates."""
    _, reps = es_points_and_reps(spark, sf)
    other = reps.select("rep", F.col("k").alias("k2"), F.col("beta").alias("beta2"))
    return reps.join(other, "rep").groupBy("k", "k2").agg(F.covar_samp("beta", "beta2").alias("cov"))


def grouped_study(spark, sf, key: str, seed: str, least: int = 150):
    """Event-study curves with intervals for every group of ``least`` units."""
    rows = es_rows(spark, sf)
    rows = ag.named_groups(rows, key) if key == "agent" else rows
    big = rows.groupBy(key).agg(F.count_distinct("pid").alias("_u")).where(F.col("_u") >= least)
    return es.curve(rows.join(big, key, "left_semi"), "pid", [key], B["event"], seed, min_n=10).select(key, "k", "n", "beta", "lo", "hi", "p_gt0")


def grouped_sql(key: str, seed: str, least: int) -> str:
    named = " WHERE agent <> ''" if key == "agent" else ""
    return (
        f", bg AS (SELECT {key} FROM es{named} GROUP BY 1 HAVING count(DISTINCT pid) >= {least}), gr AS (SELECT es.* FROM es WHERE {key} IN (SELECT {key} FROM bg)), "
        f"gk AS (SELECT {key}, k, count(*) AS n, avg(beta) AS beta FROM gr GROUP BY 1, 2 HAVING count(*) >= 10), su AS (SELECT pid, {key}, k, count(*) AS n, sum(beta) AS s FROM gr GROUP BY 1, 2, 3),\n"
        + multinomial_sql("SELECT DISTINCT pid FROM gr", "pid", B["event"], seed)
        + f", rp AS (SELECT rep, {key}, k, sum(w * s) / sum(w * n) AS rb FROM su JOIN wt USING (pid) GROUP BY 1, 2, 3) SELECT {key}, k, {n('any_value(n)', 'n')}, {r('any_value(beta)', 'beta')}, {r('quantile_cont(rb, 0.025)', 'lo')}, {r('quantile_cont(rb, 0.975)', 'hi')}, {r('avg(CASE WHEN rb > 0 THEN 1.0 ELSE 0.0 END)', 'p_gt0')} FROM rp JOIN gk USING ({key}, k) GROUP BY 1, 2"
    )


@query("event_study_by_cohort", L + ES + grouped_sql("year", "y", 20))
def _(spark, sf):
    """20 units a cohort instead of 150: the small tables have few units."""
    return grouped_study(spark, sf, "year", "y", 20)


@query("event_study_by_agent", L + ES + grouped_sql("agent", "a", 20))
def _(spark, sf):
    """20 units an agent instead of 150: the small tables have few units."""
    return grouped_study(spark, sf, "agent", "a", 20)


@query(
    "cohort_abs_strata",
    L + f", z AS (SELECT *, {BANDS} FROM lp WHERE n_ctrl >= 30), g AS (SELECT 'elev' AS grouping, elev_band AS level, * FROM z UNION ALL SELECT 'area', area_band, * FROM z) SELECT grouping, level, year, epoch, {n('count(*)', 'n')}, {r('avg(v) / 1e5', 'unit_level')}, {r('avg(ctl) / 1e5', 'control_level')}, {r('avg(dlst)', 'gap')}, {r('stddev_samp(dlst) / sqrt(count(*))', 'se')} FROM g WHERE level IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 15",
)
def _(spark, sf):
    """The absolute cohort series by elevation and by area."""
    lp = fx.long_panel(spark, sf).where(F.col("n_ctrl") >= 30)
    levels = F.array(F.struct(F.lit("elev").alias("grouping"), bn.band_of("elev", ELEV).alias("level")), F.struct(F.lit("area").alias("grouping"), bn.band_of("area_ha", AREA).alias("level")))
    rows = lp.select("year", "epoch", "v", "ctl", "dlst", F.inline(levels)).where(F.col("level").isNotNull())
    g = rows.groupBy("grouping", "level", "year", "epoch").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("v") / 1e5).alias("unit_level"), (F.avg("ctl") / 1e5).alias("control_level"), F.avg("dlst").alias("gap"), fc.standard_error("dlst").alias("se")
    )
    return g.where(F.col("n") >= 15)


@query("maximum_mosaic", G + f"SELECT \"row\", \"col\", {r('max(v)', 'value', 9)} FROM (SELECT \"row\", \"col\", CASE WHEN slope > 15 THEN lst END AS v FROM grid UNION ALL SELECT \"row\", \"col\", elev / 50 FROM grid WHERE elev < 1200) WHERE v IS NOT NULL GROUP BY 1, 2", 9)
def _(spark, sf):
    g = fx.pixel_grid(spark, sf)
    layers = [F.when(F.col("slope") > 15, F.col("lst")), F.when(F.col("elev") < 1200, F.col("elev") / 50)]
    return sp.largest_valid([g.select("row", "col", v.alias("value")) for v in layers], "value")
