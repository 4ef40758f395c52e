"""Queries for DiD, event studies, fixed effects, regressions, models, streams and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from regrowth.functions import columns as fc
from regrowth.functions.small_math import t_two_sided
from regrowth.operators import aggregate as ag
from regrowth.operators import binning as bn
from regrowth.operators import bootstrap as bt
from regrowth.operators import did
from regrowth.operators import event_study as es
from regrowth.operators import fitting as ft
from regrowth.operators import fixed_effects as fe
from regrowth.operators import models as ml
from regrowth.operators import quantiles as qt
from regrowth.operators import ranking as rk
from regrowth.operators import regression as rg
from regrowth.operators import verify as vf
from regrowth.plans import fixtures as fx
from regrowth.plans.joins_and_windows import KEEP, PREPOST
from regrowth.plans.recovery import EV, event_post, multinomial_sql, poisson_sql
from regrowth.plans.registry import n, query, r
from regrowth.plans.sources_and_panel import AREA, ELEV, NET
from regrowth.plans.sql_fit import MELT, bins_sql, fit_sql
from regrowth.session import materialise
from regrowth.streaming import accumulate as st

L, P, S = f"WITH {fx.LONG_SQL}\n", f"WITH {fx.PIXEL_SQL}\n", f"WITH {fx.SCENE_SQL}\n"

# ---------------- difference-in-differences ----------------

DID = f", pp AS (SELECT *, post_v - pre_v AS did_v FROM ({PREPOST}))"
DID_COLS = f"{n('count(*)', 'n')}, {r('avg(pre_v)', 'pre')}, {r('avg(post_v)', 'post')}, {r('avg(did_v)', 'did')}, {r('stddev_samp(did_v) / sqrt(count(*))', 'se')}"


def pairs(spark, sf, value="dlst"):
    return did.pre_post(fx.long_panel(spark, sf), "pid", "year", value, ["agent", "elev", "area_ha", "src"])


@query("did_cohort", L + DID + f" SELECT year, {DID_COLS} FROM pp WHERE src = 'event' GROUP BY 1 HAVING count(*) >= 8")
def _(spark, sf):
    return did.did_by(pairs(spark, sf).where(F.col("src") == "event"), ["year"])


@query("did_by_group", L + DID + f" SELECT year, CASE WHEN grouping(agent) = 1 THEN 'all' ELSE agent END AS agent, {DID_COLS} FROM pp WHERE src = 'event' GROUP BY GROUPING SETS ((year), (year, agent)) HAVING count(*) >= 8 AND (grouping(agent) = 1 OR agent IS NOT NULL)")
def _(spark, sf):
    return did.did_with_total(pairs(spark, sf).where(F.col("src") == "event"), "year", "agent")


@query("placebo_by_agent", L + DID + f" SELECT agent, {n('count(*)', 'n')}, {r('avg(pre_v)', 'mean')}, {r('stddev_samp(pre_v) / sqrt(count(*))', 'se')} FROM pp WHERE src = 'event' AND agent <> '' GROUP BY 1 HAVING count(*) >= 8")
def _(spark, sf):
    return ag.mean_se(ag.named_groups(pairs(spark, sf).where(F.col("src") == "event"), "agent"), ["agent"], "pre_v", 8)


@query("did_second_measure", L + DID.replace("dlst", "dndvi") + f" SELECT year, {DID_COLS} FROM pp WHERE src = 'event' GROUP BY 1 HAVING count(*) >= 8")
def _(spark, sf):
    return did.did_by(pairs(spark, sf, "dndvi").where(F.col("src") == "event"), ["year"])


BANDS = "CASE WHEN elev >= 0 AND elev < 1000 THEN 'lt1000' WHEN elev >= 1000 AND elev < 2000 THEN '1000_2000' WHEN elev >= 2000 AND elev < 9999 THEN 'gt2000' END AS elev_band, CASE WHEN area_ha < 2 THEN 'lt2' WHEN area_ha < 10 THEN '2_10' ELSE 'ge10' END AS area_band"


@query(
    "did_pooled",
    L + DID + f", z AS (SELECT *, {BANDS} FROM pp WHERE src = 'event') SELECT CASE WHEN grouping(agent) = 0 THEN 'agent' WHEN grouping(elev_band) = 0 THEN 'elev_band' WHEN grouping(area_band) = 0 THEN 'area_band' ELSE 'all' END AS grouping, CASE WHEN grouping(agent) = 0 THEN agent WHEN grouping(elev_band) = 0 THEN elev_band WHEN grouping(area_band) = 0 THEN area_band ELSE 'all' END AS level, {DID_COLS}, {n('min(year)', 'year0')}, {n('max(year)', 'year1')} FROM z GROUP BY GROUPING SETS ((), (agent), (elev_band), (area_band)) HAVING count(*) >= 8 AND level <> ''",
)
def _(spark, sf):
    p = pairs(spark, sf).where(F.col("src") == "event").withColumns({"elev_band": bn.band_of("elev", ELEV), "area_band": bn.band_of("area_ha", AREA)})
    return did.did_pooled(p, ["agent", "elev_band", "area_band"], "year")


# ---------------- event study ----------------

B = bt.REPLICATES["event"]
ES = NET.replace("FROM lp WHERE is_pre", "FROM lp WHERE is_pre AND clean AND src = 'event'") + ", es AS (SELECT * FROM net WHERE k BETWEEN -7 AND 13 AND k <> -1)"
KG = ", kg AS (SELECT k FROM es GROUP BY 1 HAVING count(*) >= 25), ek AS (SELECT * FROM es WHERE k IN (SELECT k FROM kg)), su AS (SELECT pid, k, count(*) AS n, sum(beta) AS s FROM ek GROUP BY 1, 2),\n"
REPS = multinomial_sql("SELECT DISTINCT pid FROM es", "pid", B, "e") + ", rp AS (SELECT rep, k, sum(w * s) / sum(w * n) AS beta FROM su JOIN wt USING (pid) GROUP BY 1, 2), pt AS (SELECT k, count(*) AS n, avg(beta) AS beta FROM ek GROUP BY 1)"


def es_rows(spark, sf, value="dlst"):
    lp = fx.long_panel(spark, sf).where(F.col("clean") & (F.col("src") == "event"))
    return es.event_time_rows(lp, "pid", value)


@query("event_study", L + ES + KG + REPS + f" SELECT k, {n('any_value(q.n)', 'n')}, {n('any_value(q.u)', 'n_unit')}, {r('any_value(q.beta)', 'beta')}, {r('quantile_cont(rp.beta, 0.025)', 'lo')}, {r('quantile_cont(rp.beta, 0.975)', 'hi')}, {r('avg(CASE WHEN rp.beta > 0 THEN 1.0 ELSE 0.0 END)', 'p_gt0')} FROM rp JOIN (SELECT k, count(*) AS n, count(DISTINCT pid) AS u, avg(beta) AS beta FROM ek GROUP BY 1) q USING (k) GROUP BY k")
def _(spark, sf):
    return es.curve(es_rows(spark, sf), "pid", [], B, "e")


def es_points_and_reps(spark, sf):
    sums = es.event_time_sums(es_rows(spark, sf), "pid", [])
    return es.points_by_k(sums, "pid", []), es.replicate_curve(sums, "pid", [], B, "e", 25)


def wald_sql(size: int) -> str:
    """b' V^-1 b through an unrolled Cholesky factor of the replicate covariance of ``size`` leads."""
    cells, fwd = [], []
    for i in range(1, size + 1):
        for j in range(1, i + 1):
            v = f"max(v) FILTER (i = {i} AND j = {j})"
            cells.append(f"{v} AS v{i}{j}")
    for i in range(1, size + 1):
        for j in range(1, i + 1):
            minus = "".join(f" - l{i}{m} * l{j}{m}" for m in range(1, j))
            fwd.append(f"sqrt(v{i}{i}{minus}) AS l{i}{i}" if i == j else f"(v{i}{j}{minus}) / l{j}{j} AS l{i}{j}")
        fwd.append(f"(b{i}{''.join(f' - l{i}{m} * z{m}' for m in range(1, i))}) / l{i}{i} AS z{i}")
    bs = ", ".join(f"max(beta) FILTER (i = {i}) AS b{i}" for i in range(1, size + 1))
    total = " + ".join(f"z{i} * z{i}" for i in range(1, size + 1))
    return (
        f", ld AS (SELECT k, beta, row_number() OVER (ORDER BY k) AS i FROM pt WHERE k <= -2 AND n >= 25), rl AS (SELECT rep, i, rp.beta FROM rp JOIN ld USING (k)), ok AS (SELECT rep FROM rl GROUP BY 1 HAVING count(*) = {size}),"
        f" cv AS (SELECT a.i, b.i AS j, covar_samp(a.beta, b.beta) AS v FROM rl a JOIN rl b USING (rep) WHERE rep IN (SELECT rep FROM ok) GROUP BY 1, 2),"
        f" mv AS (SELECT {', '.join(cells)} FROM cv), mb AS (SELECT {bs} FROM ld), ch AS (SELECT {', '.join(fwd)} FROM mv, mb), wd AS (SELECT {total} AS wald FROM ch)"
    )


N_LEADS = 3  # leads of the fixture that reach the gate at the checked scale


@query("pretrend_wald", L + ES + KG + REPS + wald_sql(N_LEADS) + f" SELECT {n(str(N_LEADS), 'df')}, {r('wald', 'wald', 4)} FROM wd", 4)
def _(spark, sf):
    points, reps = es_points_and_reps(spark, sf)
    return es.wald_of_leads(points, reps).select("df", "wald")


TAIL = (  # upper chi-square tail for 3 degrees of freedom: Simpson's rule on 2 u^2 exp(-u^2 / 2) / sqrt(2 pi)
    "1 - (SELECT sum(h / 3 * (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * 2 * power(i * h, 2) * exp(-power(i * h, 2) / 2) / sqrt(2 * pi())) "
    "FROM (SELECT sqrt(wald) / 2000 AS h), (SELECT unnest(range(0, 2001)) AS i))"
)


@query("pretrend_wald_p", L + ES + KG + REPS + wald_sql(N_LEADS) + f" SELECT {n(str(N_LEADS), 'df')}, {r('wald', 'wald', 4)}, {r(TAIL, 'p', 4)} FROM wd", 4)
def _(spark, sf):
    points, reps = es_points_and_reps(spark, sf)
    return es.wald_of_leads(points, reps)


TERMS = """ld AS (SELECT {g}k, beta FROM {src} WHERE k <= -2), fl AS (SELECT {g}arg_min(beta, k) AS jump1, min(k) AS k1 FROM {src} WHERE k >= 1 {gb}),
ph AS (SELECT {g}k, beta FROM ld UNION ALL SELECT DISTINCT {g}-1, 0.0 FROM {src}), sp AS (SELECT {g}max(gap) AS max_step FROM (SELECT {g}abs(beta - lag(beta) OVER ({pb}ORDER BY k)) AS gap FROM ph) {gb}),
sl AS (SELECT {g}sum((k + 1) * beta) / sum((k + 1) * (k + 1)) AS slope_ref, regr_slope(beta, k + 1) AS slope_free, max(abs(beta)) AS max_abs_lead, sqrt(avg(beta * beta)) AS rms_lead FROM ld {gb})"""


def terms_sql(src: str, by: str = "") -> str:
    return TERMS.format(src=src, g=f"{by}, " if by else "", gb=f"GROUP BY {by}" if by else "", pb=f"PARTITION BY {by} " if by else "")


@query(
    "pretrend_slopes",
    L + ES + KG + REPS + ", pk AS (SELECT k, beta FROM pt WHERE n >= 25), " + terms_sql("pk")
    + f" SELECT {r('slope_ref', 'slope_ref')}, {r('slope_free', 'slope_free')}, {r('max_abs_lead', 'max_abs_lead')}, {r('rms_lead', 'rms_lead')}, {r('max_step', 'max_step')}, {n('k1', 'k1')}, {r('jump1', 'jump1')}, {r('jump1 - slope_ref * (k1 + 1)', 'adjusted_ref')}, {r('jump1 - slope_free * (k1 + 1)', 'adjusted_free')} FROM sl, fl, sp",
)
def _(spark, sf):
    return es.pretrend_terms(es_points_and_reps(spark, sf)[0].select("k", "beta"), [])


@query(
    "pretrend_slopes_ci",
    L + ES + KG + REPS + ", " + terms_sql("rp", "rep")
    + f" SELECT {n('count(*)', 'n_boot')}, {r('quantile_cont(slope_ref, 0.025)', 'slope_lo')}, {r('quantile_cont(slope_ref, 0.975)', 'slope_hi')}, {r('quantile_cont(max_step, 0.025)', 'step_lo')}, {r('quantile_cont(max_step, 0.975)', 'step_hi')}, {r('quantile_cont(jump1 - slope_ref * (k1 + 1), 0.025)', 'adj_lo')}, {r('quantile_cont(jump1 - slope_ref * (k1 + 1), 0.975)', 'adj_hi')}, {r('quantile_cont(slope_free, 0.025)', 'free_lo')}, {r('quantile_cont(slope_free, 0.975)', 'free_hi')}, {r('quantile_cont(jump1 - slope_free * (k1 + 1), 0.025)', 'adj_free_lo')}, {r('quantile_cont(jump1 - slope_free * (k1 + 1), 0.975)', 'adj_free_hi')}, {r('avg(CASE WHEN jump1 - slope_ref * (k1 + 1) > 0 THEN 1.0 ELSE 0.0 END)', 'p_gt0')} FROM sl JOIN fl USING (rep) JOIN sp USING (rep)",
)
def _(spark, sf):
    t = es.pretrend_terms(es_points_and_reps(spark, sf)[1], ["rep"])
    q = lambda x, p, name: F.percentile(x, F.lit(p)).alias(name)
    return t.agg(
        F.count(F.lit(1)).alias("n_boot"), q("slope_ref", 0.025, "slope_lo"), q("slope_ref", 0.975, "slope_hi"), q("max_step", 0.025, "step_lo"),
        q("max_step", 0.975, "step_hi"), q("adjusted_ref", 0.025, "adj_lo"), q("adjusted_ref", 0.975, "adj_hi"), q("slope_free", 0.025, "free_lo"),
        q("slope_free", 0.975, "free_hi"), q("adjusted_free", 0.025, "adj_free_lo"), q("adjusted_free", 0.975, "adj_free_hi"),
        F.avg(F.when(F.col("adjusted_ref") > 0, 1.0).otherwise(0.0)).alias("p_gt0"),
    )


@query(
    "lead_pooled",
    L + ES + ", dl AS (SELECT * FROM es WHERE k <= -2), su AS (SELECT pid, count(*) AS n, sum(beta) AS s FROM dl GROUP BY 1),\n" + multinomial_sql("SELECT DISTINCT pid FROM dl", "pid", B, "l")
    + f", rp AS (SELECT rep, sum(w * s) / sum(w * n) AS beta FROM su JOIN wt USING (pid) GROUP BY 1) SELECT {n('(SELECT count(*) FROM dl)', 'n')}, {n('(SELECT count(DISTINCT pid) FROM dl)', 'n_unit')}, {r('(SELECT avg(beta) FROM dl)', 'mean')}, {r('quantile_cont(beta, 0.025)', 'lo')}, {r('quantile_cont(beta, 0.975)', 'hi')} FROM rp",
)
def _(spark, sf):
    sums = materialise(bt.unit_sums(es_rows(spark, sf).where(F.col("k") <= -2), "pid", [], "beta"), "lead-sums")
    reps = bt.replicate_cells(sums, "pid", [], B, "l", "multinomial")
    band = reps.agg(F.percentile("mean", F.lit(0.025)).alias("lo"), F.percentile("mean", F.lit(0.975)).alias("hi"))
    point = sums.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_unit"), (F.sum("s1") / F.sum("n")).alias("mean")).alias("p")).scalar()
    return band.withColumn("p", point).select("p.*", "lo", "hi")


@query(
    "id_set_breakdown",
    L + ES + KG + REPS + ", pk AS (SELECT k, beta FROM pt WHERE n >= 25), " + terms_sql("pk")
    + f", m AS (SELECT unnest([0.5::DOUBLE, 1, 1.5, 2, 2.5, 3]) AS mbar) SELECT {r('mbar', 'mbar')}, {r('jump1 - mbar * max_step', 'lo')}, {r('jump1 + mbar * max_step', 'hi')}, (jump1 - mbar * max_step > 0 OR jump1 + mbar * max_step < 0) AS excludes_zero, {r('abs(jump1) / max_step', 'breakdown')} FROM fl, sp, m",
)
def _(spark, sf):
    terms = es.pretrend_terms(es_points_and_reps(spark, sf)[0].select("k", "beta"), [])
    return es.identified_set(terms, [0.5, 1.0, 1.5, 2.0, 2.5, 3.0])


# ---------------- fixed effects ----------------

FE = EV + KEEP.replace("FROM post", "FROM ev")
SHAPE = ", g AS (SELECT *, exp(-age / 8.0) AS shape FROM fe), dm AS (SELECT pid, epoch, age, dlst, dlst - avg(dlst) OVER (PARTITION BY pid) AS yw, shape - avg(shape) OVER (PARTITION BY pid) AS gw, age - avg(age) OVER (PARTITION BY pid) AS aw FROM g)"


def fe_rows(spark, sf):
    return fe.long_enough(event_post(spark, sf), "pid").withColumn("shape", F.exp(-F.col("age") / 8.0))


@query("fe_beta", L + FE + SHAPE + f" SELECT {n('count(*)', 'n_rows')}, {n('count(DISTINCT pid)', 'n_units')}, {r('sum(yw * gw) / sum(gw * gw)', 'beta')}, {r('sum(yw * aw) / sum(aw * aw)', 'slope')} FROM dm")
def _(spark, sf):
    rows = fe_rows(spark, sf)
    m = F.count(F.lit(1))
    sums = rows.groupBy("pid").agg(
        m.alias("n"), (F.covar_pop("dlst", "shape") * m).alias("yg"), (F.var_pop("shape") * m).alias("gg"), (F.covar_pop("dlst", "age") * m).alias("ya"), (F.var_pop("age") * m).alias("aa")
    )
    return sums.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_units"), (F.sum("yg") / F.sum("gg")).alias("beta"), (F.sum("ya") / F.sum("aa")).alias("slope"))


@query(
    "fe_tau_grid",
    L + FE + f", gr AS (SELECT 1.0::DOUBLE + i * 0.25::DOUBLE AS tau FROM (SELECT unnest(range(0, 237)) AS i)), pu AS (SELECT tau, pid, sum(dlst * dlst) AS yy, sum(dlst * exp(-age / tau)) AS nu, sum(exp(-age / tau) * exp(-age / tau)) AS de FROM fe, gr GROUP BY 1, 2), sr AS (SELECT tau, sum(yy - CASE WHEN de > 1e-12 THEN nu * nu / de ELSE 0 END) AS ssr FROM pu GROUP BY 1) SELECT {r('tau', 'tau_fe')}, {r('ssr', 'ssr', 4)} FROM sr ORDER BY round(ssr, 9), tau LIMIT 1",
    4,
)
def _(spark, sf):
    return fe.tau_by_grid(fe_rows(spark, sf), "pid", "dlst", "age")


TAU_BOOT = 150  # replicates of the tau search


def within_sql() -> str:
    """Both measures: pooled fit, units' sums and costs, weights of each measure's units, statistics of the replicates."""
    kept = "SELECT measure, pid FROM ml WHERE src = 'event' GROUP BY ALL HAVING count(*) >= 4 AND max(age) - min(age) >= 4"
    bins = bins_sql("(SELECT * FROM ml WHERE src = 'event')", "measure", "y", 12)
    weights = ",\n".join(multinomial_sql(f"SELECT pid FROM ku WHERE measure = '{m}'", "pid", bt.REPLICATES["within"], f"f-{m}", f"w_{m}") for m in ("dlst", "dndvi"))
    return (
        L + ", " + MELT + ",\n" + fit_sql(bins, "measure", "f") + f", ku AS ({kept}), fm AS (SELECT measure, pid, age, y, exp(-age / tau) AS g FROM ml JOIN ku USING (measure, pid) JOIN f USING (measure) WHERE src = 'event'),\n"
        "dm AS (SELECT measure, pid, y - avg(y) OVER w AS y, g - avg(g) OVER w AS g, age - avg(age) OVER w AS a FROM fm WINDOW w AS (PARTITION BY measure, pid)),\n"
        "us AS (SELECT measure, pid, count(*) AS n, sum(y * g) AS gy, sum(g * g) AS gg, sum(y * a) AS ay, sum(a * a) AS aa FROM dm GROUP BY ALL),\n"
        "gr AS (SELECT i, 1.0::DOUBLE + i * 0.25::DOUBLE AS tau FROM (SELECT unnest(range(0, 237)) AS i)),\n"
        "co AS (SELECT measure, pid, i, gr.tau, sum(y * y) - CASE WHEN sum(exp(-2 * age / gr.tau)) > 1e-12 THEN power(sum(y * exp(-age / gr.tau)), 2) / sum(exp(-2 * age / gr.tau)) ELSE 0 END AS cost FROM fm, gr GROUP BY ALL),\n"
        + weights + ",\nwt AS (SELECT 'dlst' AS measure, * FROM w_dlst UNION ALL SELECT 'dndvi', * FROM w_dndvi),\n"
        f"rt AS (SELECT measure, rep, tau, sum(w * cost) AS c FROM co JOIN wt USING (measure, pid) WHERE i % 2 = 0 AND rep <= {TAU_BOOT} GROUP BY ALL),\n"
        "rb AS (SELECT measure, rep, arg_min(tau, round(c, 9) * 1e3 + tau * 1e-9) AS tau FROM rt GROUP BY ALL),\n"
        "rp AS (SELECT measure, rep, sum(w * gy) / sum(w * gg) AS beta, sum(w * ay) / sum(w * aa) AS slope FROM us JOIN wt USING (measure, pid) GROUP BY ALL),\n"
        "pt AS (SELECT measure, sum(n) AS n_rows, count(*) AS n_units, sum(gy) / sum(gg) AS beta, sum(ay) / sum(aa) AS slope FROM us GROUP BY ALL),\n"
        "ct AS (SELECT measure, arg_min(tau, round(c, 9) * 1e3 + tau * 1e-9) AS tau FROM (SELECT measure, tau, sum(cost) AS c FROM co GROUP BY ALL) GROUP BY ALL),\n"
        "ps AS (SELECT measure, avg(-amp / tau * exp(-age / tau)) AS s FROM fm JOIN f USING (measure) GROUP BY ALL)\n"
        f"SELECT measure, {n('any_value(pt.n_rows)', 'n_rows')}, {n('any_value(pt.n_units)', 'n_units')}, {n('count(rp.beta)', 'n_boot')}, {n('count(rb.tau)', 'n_boot_tau')}, {r('any_value(f.tau)', 'tau_pooled', 3)}, {r('any_value(f.amp)', 'amp_pooled', 3)}, "
        f"{r('any_value(ps.s)', 'pooled_slope', 3)}, {r('any_value(pt.beta)', 'beta', 3)}, {r('quantile_cont(rp.beta, 0.025)', 'beta_lo', 3)}, {r('quantile_cont(rp.beta, 0.975)', 'beta_hi', 3)}, {r('any_value(pt.beta / f.amp)', 'frac', 3)}, "
        f"{r('quantile_cont(rp.beta, 0.025) / any_value(f.amp)', 'frac_lo', 3)}, {r('quantile_cont(rp.beta, 0.975) / any_value(f.amp)', 'frac_hi', 3)}, {r('any_value(pt.slope)', 'slope', 3)}, {r('quantile_cont(rp.slope, 0.025)', 'slope_lo', 3)}, "
        f"{r('quantile_cont(rp.slope, 0.975)', 'slope_hi', 3)}, {r('any_value(ct.tau)', 'tau_fe', 3)}, {r('quantile_cont(rb.tau, 0.025)', 'tau_lo', 3)}, {r('quantile_cont(rb.tau, 0.975)', 'tau_hi', 3)}, {r('avg(CASE WHEN sign(rp.beta) = sign(f.amp) THEN 1.0 ELSE 0 END)', 'p_same_sign', 3)}\n"
        "FROM rp LEFT JOIN rb USING (measure, rep) JOIN pt USING (measure) JOIN f USING (measure) JOIN ct USING (measure) JOIN ps USING (measure) GROUP BY measure"
    )


@query("fe_bootstrap", within_sql(), 3)
def _(spark, sf):
    """Within-unit share, slope and tau with their intervals for both measures; shape and amplitude from the pooled fit."""
    out = []
    for m in ("dlst", "dndvi"):
        rows = event_post(spark, sf).where(F.col(m).isNotNull())
        clock = ft.recovery_fit(rows.withColumn("one", F.lit(0)), ["one"], m)
        kept = fe.long_enough(rows, "pid")
        out.append(fe.within_intervals(kept, "pid", m, "age", clock, bt.REPLICATES["within"], TAU_BOOT, f"f-{m}").withColumn("measure", F.lit(m)))
    return rk.union_all(out)


def two_way_sql(periods: list[str], carry: str = "") -> str:
    """Exact two-way slope by sweeping out one demeaned period dummy after another."""
    d = [f"p{i}" for i in range(1, len(periods))]
    raw = ", ".join(f"CASE WHEN epoch = '{p}' THEN 1.0::DOUBLE ELSE 0 END AS p{i}" for i, p in enumerate(periods) if i)
    cols = ["dlst", "shape", *d]
    parts = [f"t0 AS (SELECT {carry}pid, {', '.join(f'{x} - avg({x}) OVER (PARTITION BY pid) AS {x}' for x in cols)} FROM (SELECT {carry}pid, dlst, shape, {raw} FROM g))"]
    rest = list(cols)
    for i, x in enumerate(d):
        rest.remove(x)
        coef = ", ".join(f"sum({y} * {x}) / sum({x} * {x}) AS c_{y}" for y in rest)
        parts.append(f"q{i} AS (SELECT {coef} FROM t{i}), t{i + 1} AS (SELECT {carry}pid, {', '.join(f'{y} - c_{y} * {x} AS {y}' for y in rest)} FROM t{i}, q{i})")
    return ", " + ",\n".join(parts) + f", fin AS (SELECT sum(dlst * shape) / sum(shape * shape) AS beta2, sum(shape * shape) AS left_ FROM t{len(d)})"


@query("fe_two_way", L + FE + SHAPE + two_way_sql(list(fx.PERIODS)) + f", one AS (SELECT count(*) AS n_rows, sum(yw * gw) / sum(gw * gw) AS beta1, sum(gw * gw) AS gg FROM dm) SELECT {n('n_rows', 'n_rows')}, {r('beta1', 'beta_unit')}, {r('beta2', 'beta_two_way')}, {r('left_ / gg', 'share_left')} FROM one, fin")
def _(spark, sf):
    return fe.two_way(fe_rows(spark, sf), "pid", "epoch", "dlst", "shape", list(fx.PERIODS))


@query("two_way_demean", L + FE + SHAPE + two_way_sql(list(fx.PERIODS), "epoch, ") + f" SELECT pid, epoch, {r('dlst', 'dlst_tw')}, {r('shape', 'shape_tw')} FROM t{len(fx.PERIODS) - 1}")
def _(spark, sf):
    return fe.two_way_demean(fe_rows(spark, sf), "pid", "epoch", ["dlst", "shape"], list(fx.PERIODS)).select("pid", "epoch", "dlst_tw", "shape_tw")


HARSH = ", hx AS (SELECT epoch, avg(v) / 1e5 - (SELECT avg(v) / 1e5 FROM lp) AS harsh FROM lp GROUP BY 1), hd AS (SELECT ev.pid, dlst, least(greatest(trunc(age), 1), 21) AS ab, harsh FROM ev JOIN hx USING (epoch))"


def harsh_rows(spark, sf):
    lp = fx.long_panel(spark, sf)
    whole = lp.agg(F.avg("v") / 1e5).scalar()
    index = lp.groupBy("epoch").agg((F.avg("v") / 1e5).alias("m")).select("epoch", (F.col("m") - whole).alias("harsh"))
    return lp.where(fc.after_event() & (F.col("src") == "event")).join(index, "epoch").withColumn("ab", bn.truncated_bin())


@query("ols_dummies", L + EV + HARSH + f", z AS (SELECT dlst - avg(dlst) OVER (PARTITION BY ab) AS y, harsh - avg(harsh) OVER (PARTITION BY ab) AS x FROM hd) SELECT {n('count(*)', 'n_rows')}, {r('sum(x * y) / sum(x * x)', 'beta')} FROM z")
def _(spark, sf):
    return fe.slope_given_bins(harsh_rows(spark, sf), "ab", "dlst", "harsh")


@query(
    "ols_dummies_ci",
    L + EV + HARSH + ", us AS (SELECT pid, ab, count(*) AS n, sum(dlst) AS sy, sum(harsh) AS sx, sum(harsh * dlst) AS sxy, sum(harsh * harsh) AS sxx FROM hd GROUP BY 1, 2),\n" + poisson_sql("SELECT DISTINCT pid FROM us", "pid", bt.REPLICATES["bins"], "h")
    + f", cl AS (SELECT rep, ab, sum(w * n) AS n, sum(w * sy) AS sy, sum(w * sx) AS sx, sum(w * sxy) AS sxy, sum(w * sxx) AS sxx FROM us JOIN wt USING (pid) GROUP BY 1, 2), rp AS (SELECT rep, sum(sxy - sx * sy / n) / sum(sxx - sx * sx / n) AS beta FROM cl GROUP BY 1) SELECT {n('count(*)', 'n_boot')}, {r('avg(beta)', 'boot_mean', 5)}, {r('quantile_cont(beta, 0.025)', 'lo', 5)}, {r('quantile_cont(beta, 0.975)', 'hi', 5)} FROM rp",
    5,
)
def _(spark, sf):
    rows = harsh_rows(spark, sf)
    reps = fe.bootstrap_slope_given_bins(fe.cross_sums(rows, "pid", "ab", "dlst", "harsh"), "pid", "ab", bt.REPLICATES["bins"], "h")
    return bt.interval(reps, [], "beta").drop("p_gt")


# ---------------- grouped regression ----------------


def sweep_sql(source: str, key: str, y: str, xs: list[str], out: str, carry: str) -> str:
    """Grouped residual of y on xs by sweeping one centred covariate after another."""
    cols = [y, *xs]
    parts = [f"{out}0 AS (SELECT {key}, {carry}, {', '.join(f'{v} - avg({v}) OVER (PARTITION BY {key}) AS c_{v}' for v in cols)} FROM {source})"]
    rest = list(cols)
    for i, x in enumerate(xs):
        rest.remove(x)
        coef = ", ".join(f"sum(c_{v} * c_{x}) / sum(c_{x} * c_{x}) AS k_{v}" for v in rest)
        parts.append(
            f"{out}k{i} AS (SELECT {key}, {coef} FROM {out}{i} GROUP BY 1), {out}{i + 1} AS (SELECT {key}, {carry}, {', '.join(f'c_{v} - k_{v} * c_{x} AS c_{v}' for v in rest)} FROM {out}{i} JOIN {out}k{i} USING ({key}))"
        )
    return ",\n".join(parts) + f",\n{out} AS (SELECT {key}, {carry}, c_{y} AS res FROM {out}{len(xs)})"


SLICED = ", sx AS (SELECT *, CAST(floor(elev / 250) AS BIGINT) AS slice FROM px), gs AS (SELECT * FROM sx WHERE slice IN (SELECT slice FROM sx GROUP BY 1 HAVING count(*) >= 500))"
XS = ["cos_i", "slope", "northness"]


def sliced(spark, sf):
    return fx.pixel_sample(spark, sf).withColumn("slice", bn.height_slice())


@query("terrain_residual", P + SLICED + ",\n" + sweep_sql("gs", "slice", "lst", XS, "rs", "l_orderkey, l_linenumber, chm, elev") + f" SELECT slice, {n('count(*)', 'n')}, {r('sqrt(avg(res * res))', 'rms')}, {r('corr(res, chm)', 'r_chm')} FROM rs GROUP BY 1")
def _(spark, sf):
    return rg.residual_moments(sliced(spark, sf), ["slice"], "lst", XS, "chm", 500).select("slice", "n", "rms", F.col("r").alias("r_chm"))


GROUND = {"low": (0.0, 1200.0), "middle": (1200.0, 2400.0), "high": (2400.0, 3601.0)}
BANDED = ", bx AS (SELECT *, CASE WHEN elev < 1200 THEN 'low' WHEN elev < 2400 THEN 'middle' ELSE 'high' END AS band FROM px WHERE elev >= 0 AND elev < 3601)"
CENTRED = ", rc AS (SELECT rb.*, res + avg(lst) OVER (PARTITION BY band) AS back FROM rb)"


@query(
    "terrain_recentred",
    P + BANDED + ",\n" + sweep_sql("bx", "band", "lst", ["elev", *XS], "rb", "lst, chm") + CENTRED
    + f" SELECT band, {n('count(*)', 'n')}, {r('avg(back)', 'mean')}, {r('sqrt(avg(back * back))', 'rms')}, {r('regr_slope(back, chm)', 'slope')}, {r('regr_intercept(back, chm)', 'intercept')}, {r('corr(back, chm)', 'r')} FROM rc GROUP BY 1 HAVING count(*) >= 2000",
)
def _(spark, sf):
    """Height gradient of the residual about its band's own mean, with elevation among the covariates."""
    rows = fx.pixel_sample(spark, sf).withColumn("band", bn.band_of("elev", [(k, *v) for k, v in GROUND.items()])).where(F.col("band").isNotNull())
    return rg.residual_moments(rows, ["band"], "lst", ["elev", *XS], "chm", 2000, recentre=True)


CONTRAST = "SELECT slice, count(*) AS n, (avg(res) FILTER (chm >= 25 AND chm < 30) - avg(res) FILTER (chm >= 20 AND chm < 25)) * 2 AS slope, 2 * sqrt(var_pop(res) FILTER (chm >= 20 AND chm < 25) / count(*) FILTER (chm >= 20 AND chm < 25) + var_pop(res) FILTER (chm >= 25 AND chm < 30) / count(*) FILTER (chm >= 25 AND chm < 30)) AS se FROM {src} GROUP BY 1 HAVING count(*) FILTER (chm >= 20 AND chm < 25) > 50 AND count(*) FILTER (chm >= 25 AND chm < 30) > 50"


@query("window_contrast", P + SLICED + f", w AS ({CONTRAST.replace('var_pop', 'var_samp').replace('res', 'lst').format(src='sx')}) SELECT slice, {n('n', 'n')}, {r('slope', 'slope')}, {r('se', 'se')} FROM w")
def _(spark, sf):
    return rg.window_contrast(sliced(spark, sf), ["slice"], "chm", "lst", 20.0, 25.0, 30.0, 50, ddof=1)


P_SQL = "(SELECT 2 * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt(pi()) * sum(h / 3 * (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * power(greatest(cos(a0 + i * h), 0), n - 3)) FROM (SELECT atan(abs(t) / sqrt(n - 2.0)) AS a0, (pi() / 2 - atan(abs(t) / sqrt(n - 2.0))) / 2000 AS h), (SELECT unnest(range(0, 2001)) AS i))"


@query(
    "slice_sensitivity",
    P + SLICED + ",\n" + sweep_sql("gs", "slice", "lst", XS, "rs", "chm") + ",\n" + sweep_sql("gs", "slice", "lst", [*XS, "elev"], "re", "chm")
    + f", w AS (SELECT 'without' AS model, * FROM ({CONTRAST.format(src='rs')}) UNION ALL SELECT 'with_elev', * FROM ({CONTRAST.format(src='re')})), pm AS (SELECT model, sum(slope / (se * se)) / sum(1 / (se * se)) AS pm FROM w GROUP BY 1), t0 AS (SELECT model, count(*) AS n, corr(slope, slice * 250 + 125) AS r FROM w GROUP BY 1), t AS (SELECT model, n, r * sqrt((n - 2) / (1 - r * r)) AS t FROM t0), tp AS (SELECT model, {P_SQL} AS tp FROM t) SELECT model, {n('count(*)', 'n')}, {r('sum(slope / (se * se)) / sum(1 / (se * se))', 'pooled')}, {r('sqrt(1 / sum(1 / (se * se)))', 'pooled_se')}, {r('regr_slope(slope, slice * 250 + 125) * 1000', 'trend')}, {r('sum(power(slope - pm, 2) / (se * se))', 'cochran_q')}, {r('any_value(tp)', 'trend_p')} FROM w JOIN pm USING (model) JOIN tp USING (model) GROUP BY 1",
)
def _(spark, sf):
    both = rg.residual_windows(sliced(spark, sf), ["slice"], "lst", {"without": XS, "with_elev": [*XS, "elev"]}, "chm", 20.0, 25.0, 30.0, 50, ddof=0, min_n=500)
    # pooled value, trend over the slices' heights and spread about the pooled value, all in one aggregate
    w, v, mid = 1 / (F.col("se") * F.col("se")), F.col("slope"), (F.col("slice") * 250 + 125).cast("double")
    count = F.count(F.lit(1))
    g = both.groupBy("model").agg(
        count.alias("n"), (F.sum(w * v) / F.sum(w)).alias("pooled"), F.sqrt(1 / F.sum(w)).alias("pooled_se"), (F.regr_slope(v, mid) * 1000).alias("trend"),
        F.corr(v, mid).alias("_r"), (F.sum(w * v * v) - F.sum(w * v) * F.sum(w * v) / F.sum(w)).alias("cochran_q"),
    )
    df = (F.col("n") - 2).cast("double")
    return g.withColumn("trend_p", t_two_sided(F.col("_r") * F.sqrt(df / (1 - F.col("_r") * F.col("_r"))), df)).drop("_r")


ANOM = ", md AS (SELECT slice, median(res) AS m FROM rs WHERE chm >= 24 AND chm < 26 GROUP BY 1), an AS (SELECT rs.*, res - m AS anom FROM rs JOIN md USING (slice))"


def anomalies(spark, sf):
    """Residual minus the slice's median residual in the 24-26 height class."""
    res = rg.residuals(sliced(spark, sf), ["slice"], "lst", XS, 500)
    ref = qt.medians(res.where((F.col("chm") >= 24) & (F.col("chm") < 26)), ["slice"], "res", "_m")
    return res.join(ref, "slice").withColumn("anom", F.col("res") - F.col("_m"))


@query("reference_anomaly", P + SLICED + ",\n" + sweep_sql("gs", "slice", "lst", XS, "rs", "chm") + ANOM + f" SELECT slice, {n('count(*)', 'n')}, {r('avg(anom)', 'mean')}, {r('min(anom)', 'lo')}, {r('max(anom)', 'hi')} FROM an GROUP BY 1")
def _(spark, sf):
    return anomalies(spark, sf).groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.avg("anom").alias("mean"), F.min("anom").alias("lo"), F.max("anom").alias("hi"))


@query(
    "binned_curve_slope",
    P + SLICED + ",\n" + sweep_sql("gs", "slice", "lst", XS, "rs", "chm") + ANOM
    + f""", cv AS (SELECT floor(chm) + 0.5::DOUBLE AS x, avg(anom) AS y FROM an WHERE chm >= 8 AND chm <= 50 AND anom > -6.2 AND anom < 6.2 GROUP BY 1 HAVING count(*) >= 80),
    q AS (SELECT h, s, h + s * 3 AS x_at FROM (SELECT unnest([15.0::DOUBLE, 20, 25, 30, 35, 40]) AS h), (SELECT unnest([-1, 1]) AS s)),
    b AS (SELECT h, s, x_at, max(x) FILTER (x <= x_at) AS x0, arg_max(y, x) FILTER (x <= x_at) AS y0, min(x) FILTER (x >= x_at) AS x1, arg_min(y, x) FILTER (x >= x_at) AS y1 FROM q, cv GROUP BY 1, 2, 3),
    v AS (SELECT h, s, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (x_at - x0) / (x1 - x0) END AS v FROM b)
    SELECT {r('h', 'height')}, {r('(max(v) FILTER (s = 1) - max(v) FILTER (s = -1)) / 6 * 10', 'slope')} FROM v GROUP BY 1""",
)
def _(spark, sf):
    a = anomalies(spark, sf).where((F.col("chm") >= 8) & (F.col("chm") <= 50) & (F.col("anom") > -6.2) & (F.col("anom") < 6.2))
    curve = a.groupBy(F.lit(0).alias("one"), (F.floor("chm") + 0.5).alias("x")).agg(F.avg("anom").alias("y"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 80)
    heights = [15.0, 20.0, 25.0, 30.0, 35.0, 40.0]
    at = rg.interpolate(curve, ["one"], "x", "y", [h + s for h in heights for s in (-3.0, 3.0)])
    side = F.explode(F.array(F.lit(-3.0), F.lit(3.0)))
    rows = at.withColumn("s", side).withColumn("height", F.col("x_at") - F.col("s")).where(F.col("height").isin(*heights))
    g = rows.groupBy("height").agg(F.max(F.when(F.col("s") == 3.0, F.col("value"))).alias("hi"), F.max(F.when(F.col("s") == -3.0, F.col("value"))).alias("lo"))
    return g.select("height", ((F.col("hi") - F.col("lo")) / 6 * 10).alias("slope"))



@query(
    "linregress_se_p",
    P + f", g AS (SELECT CAST(floor(elev / 250) AS BIGINT) AS slice, count(*) AS n, regr_slope(lst, chm) AS slope, regr_intercept(lst, chm) AS intercept, corr(lst, chm) AS r, sqrt((1 - corr(lst, chm) * corr(lst, chm)) * var_pop(lst) / var_pop(chm) / (count(*) - 2)) AS slope_se FROM px GROUP BY 1), t AS (SELECT *, slope / slope_se AS t FROM g) SELECT slice, {n('n', 'n')}, {r('slope', 'slope')}, {r('intercept', 'intercept')}, {r('r', 'r')}, {r('slope_se', 'slope_se')}, {r(P_SQL, 'p')} FROM t",
)
def _(spark, sf):
    return rg.slope_with_se(sliced(spark, sf), ["slice"], "chm", "lst")


@query(
    "within_unit_slopes",
    L + EV + f""", us AS (SELECT pid, t_event < 1994 AS old, regr_slope(dlst, age) AS slope, avg(dlst) AS level FROM ev GROUP BY ALL HAVING count(*) >= 2 AND regr_slope(dlst, age) IS NOT NULL),
    gg AS (SELECT CASE WHEN grouping(old) = 1 THEN 'all' WHEN old THEN 'old' ELSE 'young' END AS grp, count(*) AS n, avg(slope) AS slope, stddev_samp(slope) / sqrt(count(*)) AS slope_se, avg(level) AS level, stddev_samp(level) / sqrt(count(*)) AS level_se FROM us GROUP BY GROUPING SETS ((), (old)) HAVING count(*) >= 10)
    SELECT grp, {n('n', 'n')}, {r('slope', 'slope')}, {r('slope_se', 'slope_se')}, {r('level', 'level')}, {r('CASE WHEN slope < 0 THEN -level / slope END', 'tau')}, {r('CASE WHEN slope < 0 THEN abs(level / slope) * sqrt(power(level_se / level, 2) + power(slope_se / slope, 2)) END', 'tau_se')} FROM gg""",
)
def _(spark, sf):
    slopes = rg.unit_slopes(event_post(spark, sf), "pid", "age", "dlst", ["t_event"])
    rows = bn.strata_rows(slopes, [("all", F.lit(True)), ("old", F.col("t_event") < 1994), ("young", F.col("t_event") >= 1994)], "grp")
    return rg.implied_tau(rows, ["grp"], growing=False)


# ---------------- one event, cohorts, classes ----------------


@query(
    "event_dive",
    L + EV + f", z AS (SELECT coalesce(contains(event, '颱風'), false) AS named, bin, count(*) AS n, count(dndvi) AS ng, avg(dlst) AS dlst, stddev_samp(dlst) / sqrt(count(*)) AS dlst_se, avg(dndvi) AS dndvi, stddev_samp(dndvi) / sqrt(count(dndvi)) AS dndvi_se FROM ev GROUP BY 1, 2 HAVING count(*) >= 20) SELECT named, {r('0.6::DOUBLE + bin + 0.5::DOUBLE', 'age')}, {n('n', 'n')}, {r('dlst', 'dlst')}, {r('dlst_se', 'dlst_se')}, {r('dndvi', 'dndvi')}, {r('dndvi_se', 'dndvi_se')} FROM z",
)
def _(spark, sf):
    ev = event_post(spark, sf).withColumn("bin", bn.age_bin())
    g = ev.groupBy(fc.contains_or_false("event", "颱風").alias("named"), "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("dlst").alias("dlst"), (F.stddev_samp("dlst") / F.sqrt(F.count(F.lit(1)))).alias("dlst_se"), F.avg("dndvi").alias("dndvi"), fc.standard_error("dndvi").alias("dndvi_se")
    )
    return g.where(F.col("n") >= 20).withColumn("age", bn.bin_centre()).drop("bin")


@query(
    "event_dive_strata",
    L + EV + f", z AS (SELECT *, {BANDS} FROM ev WHERE coalesce(contains(event, '颱風'), false)), g AS (SELECT CASE WHEN grouping(area_band) = 0 THEN 'area_band' ELSE 'elev_band' END AS grouping, coalesce(area_band, elev_band) AS level, count(*) AS n_rows, count(DISTINCT pid) AS n_units, avg(dlst) AS dlst, stddev_samp(dlst) / sqrt(count(*)) AS dlst_se, avg(dndvi) AS dndvi FROM z GROUP BY GROUPING SETS ((area_band), (elev_band))) SELECT grouping, level, {n('n_rows', 'n_rows')}, {n('n_units', 'n_units')}, {r('dlst', 'dlst')}, {r('dlst_se', 'dlst_se')}, {r('dndvi', 'dndvi')} FROM g WHERE n_rows >= 60 AND level IS NOT NULL",
)
def _(spark, sf):
    ev = event_post(spark, sf).where(fc.contains_or_false("event", "颱風")).withColumns({"elev_band": bn.band_of("elev", ELEV), "area_band": bn.band_of("area_ha", AREA)})
    aggs = [
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("pid").alias("n_units"), F.avg("dlst").alias("dlst"),
        (F.stddev_samp("dlst") / F.sqrt(F.count(F.lit(1)))).alias("dlst_se"), F.avg("dndvi").alias("dndvi"),
    ]
    g = ag.with_total(ev, ["area_band", "elev_band"], aggs)
    return g.where((F.col("grouping") != "all") & (F.col("n_rows") >= 60) & F.col("level").isNotNull())


@query("cohort_abs_series", L + f" SELECT year, agent, epoch, {n('count(*)', 'n')}, {r('avg(v) / 1e5', 'unit_level')}, {r('avg(ctl) / 1e5', 'control_level')}, {r('avg(dlst)', 'gap')}, {r('stddev_samp(dlst) / sqrt(count(*))', 'se')} FROM lp WHERE n_ctrl >= 30 GROUP BY 1, 2, 3 HAVING count(*) >= 15")
def _(spark, sf):
    lp = fx.long_panel(spark, sf).where(F.col("n_ctrl") >= 30)
    g = lp.groupBy("year", "agent", "epoch").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("v") / 1e5).alias("unit_level"), (F.avg("ctl") / 1e5).alias("control_level"), F.avg("dlst").alias("gap"), fc.standard_error("dlst").alias("se")
    )
    return g.where(F.col("n") >= 15)


@query(
    "amplitude_by_class",
    P + f", z AS (SELECT CASE WHEN elev < 500 THEN '0-500' WHEN elev < 1000 THEN '500-1000' WHEN elev < 1500 THEN '1000-1500' WHEN elev < 2000 THEN '1500-2000' WHEN elev < 2800 THEN '2000-2800' END AS band, CASE WHEN chm < 15 THEN 'short' WHEN chm >= 22 AND chm < 60 THEN 'tall' END AS cls, lst AS day, lst * 0.5 - slope / 10 AS night FROM px WHERE cos_i > 0.35) SELECT band, cls, {n('count(*)', 'n')}, {r('avg(day)', 'day')}, {r('avg(night)', 'night')}, {r('avg(day - night)', 'amp')}, {r('stddev_pop(day - night) / sqrt(count(*))', 'amp_se')} FROM z WHERE band IS NOT NULL AND cls IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 12",
)
def _(spark, sf):
    bands = [("0-500", 0, 500), ("500-1000", 500, 1000), ("1000-1500", 1000, 1500), ("1500-2000", 1500, 2000), ("2000-2800", 2000, 2800)]
    px = fx.pixel_sample(spark, sf).where(F.col("cos_i") > 0.35).withColumns(
        {"band": bn.band_of("elev", bands), "cls": bn.band_of("chm", [("short", 0, 15), ("tall", 22, 60)]), "day": F.col("lst"), "night": F.col("lst") * 0.5 - F.col("slope") / 10}
    )
    amp = F.col("day") - F.col("night")
    g = px.where(F.col("band").isNotNull() & F.col("cls").isNotNull()).groupBy("band", "cls").agg(
        F.count(F.lit(1)).alias("n"), F.avg("day").alias("day"), F.avg("night").alias("night"), F.avg(amp).alias("amp"), (F.stddev_pop(amp) / F.sqrt(F.count(F.lit(1)))).alias("amp_se")
    )
    return g.where(F.col("n") >= 12)


# ---------------- boosted model ----------------

FEATS = ["chm", "elev", "slope", "cos_i", "northness", "eastness"]
MODEL_BANDS = [("0-1000", 0, 1000), ("1000-2000", 1000, 2000), ("2000-3600", 2000, 3601)]


def height_model(spark, sf):
    """The method's boosting, all rounds, over the rows outside the test share."""
    px = fx.pixel_sample(spark, sf)
    train, test = ml.split_by_key(px, ["l_orderkey", "l_linenumber"], 0.25, "gbt")
    return ml.fit_boosted(train, FEATS, "lst"), px, test


@query("gbt_model")
def _(spark, sf):
    model, _, test = height_model(spark, sf)
    scored = ml.predict(model, test, FEATS)
    mean = test.agg(F.avg("lst")).scalar()
    gap, dev = F.col("lst") - F.col("prediction"), F.col("lst") - F.col("_mean")
    return scored.withColumn("_mean", mean).agg(F.count(F.lit(1)).alias("n_test"), (1 - F.sum(gap * gap) / F.sum(dev * dev)).alias("r2"))


@query("partial_dependence")
def _(spark, sf):
    model, px, _ = height_model(spark, sf)
    rows = px.withColumn("band", bn.band_of("elev", MODEL_BANDS))
    base = ml.typical_rows(rows, ["band"], FEATS)
    return ml.predict(model, ml.vary(base, "chm", [5.0 + 5 * i for i in range(10)]), FEATS).select("band", "chm", "prediction")


@query("counterfactual")
def _(spark, sf):
    """Predicted contrast of height 5 against 25 and of the observed 10-90 % range, at each band's median terrain."""
    model, px, _ = height_model(spark, sf)
    rows = px.withColumn("band", bn.band_of("elev", MODEL_BANDS))
    base = ml.typical_rows(rows.where(F.col("band").isNotNull()), ["band"], FEATS, {"p10": ("chm", 0.1), "p90": ("chm", 0.9)})
    heights = F.array(*[F.struct(F.lit(k).alias("at"), v.alias("h")) for k, v in (("h5", F.lit(5.0)), ("h25", F.lit(25.0)), ("p10", F.col("p10")), ("p90", F.col("p90")))])
    rows = base.select("*", F.inline(heights)).withColumn("chm", F.col("h"))
    at = lambda k: F.max(F.when(F.col("at") == k, F.col("prediction")))
    return ml.predict(model, rows, FEATS).groupBy("band").agg((at("h25") - at("h5")).alias("wide_range"), (at("p90") - at("p10")).alias("observed_range"))


# ---------------- streams ----------------


def clear_stream(spark, sf):
    scenes = fx.scenes(spark, sf)
    instant = F.timestamp_micros(fc.utc_micros(scenes, "ts"))
    clear = scenes.where(fc.clear_sky("qa")).select("event_id", instant.alias("ts"), "cell", "epoch", "value")
    path, per_batch = st.stage_as_files(clear, "ts")
    return st.read_scene_stream(spark, path, clear.schema, per_batch)


@query("stream_composite", S + f"SELECT cell, strftime(ts, '%Y-%m') AS month, epoch, {n('count(value)', 'n')}, {r('CASE WHEN count(value) >= 3 THEN avg(value) END', 'mean', 8)} FROM clear GROUP BY ALL", 8)
def _(spark, sf):
    # daily windows, which the watermark lets leave the state; thirds of a calendar month are sums of days
    sums = st.running_sums(clear_stream(spark, sf), [F.window("ts", "1 day").alias("w"), "cell"], "value")
    state = st.latest_state(spark, st.run_to_table(sums, "composite"), ["w", "cell"]).withColumn("day", fc.utc_day("w.start"))
    third = F.concat(F.lit("w"), F.floor((F.dayofmonth("day") - 1) / 10).cast("string"))
    out = state.groupBy("cell", F.date_format("day", "yyyy-MM").alias("month"), third.alias("epoch")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return out.select("cell", "month", "epoch", "n", F.when(F.col("n") >= 3, F.col("total") / F.col("n")).alias("mean"))


@query("stream_accumulate_units", S + f"SELECT cell, strftime(ts, '%Y-%m-%d') AS day, {n('count(value)', 'n')}, {r('sum(value)', 'total', 4)} FROM clear GROUP BY ALL", 4)
def _(spark, sf):
    twice = clear_stream(spark, sf)
    twice = twice.union(twice)  # every scene delivered twice; each counts once
    sums = st.running_sums(twice, [F.col("cell"), F.window("ts", "1 day").alias("w")], "value", id_column="event_id")
    state = st.latest_state(spark, st.run_to_table(sums, "units"), ["cell", "w"])
    return state.select("cell", F.date_format(fc.utc_day("w.start"), "yyyy-MM-dd").alias("day"), "n", "total")


# ---------------- verification ----------------

VD = ", a AS (SELECT pid || '/' || epoch AS key, dlst AS value FROM lp WHERE yr < 2001), b AS (SELECT pid || '/' || epoch AS key, CASE WHEN pid % 17 = 0 THEN dlst + 1e-6 ELSE dlst + 1e-12 END AS value FROM lp WHERE yr > 1995)"


@query(
    "result_diff",
    L + VD + f" SELECT key, {r('a.value', 'old_value')}, {r('b.value', 'new_value')}, CASE WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'missing' ELSE 'changed' END AS status FROM a FULL JOIN b USING (key) WHERE a.value IS NULL OR b.value IS NULL OR abs(a.value - b.value) > 1e-9 * greatest(1, abs(a.value), abs(b.value))",
)
def _(spark, sf):
    lp = fx.long_panel(spark, sf).withColumn("key", F.concat_ws("/", "pid", "epoch"))
    nudged = F.when(F.col("pid") % 17 == 0, F.col("dlst") + 1e-6).otherwise(F.col("dlst") + 1e-12)
    return vf.result_diff(lp.where(F.col("yr") < 2001).select("key", F.col("dlst").alias("value")), lp.where(F.col("yr") > 1995).select("key", nudged.alias("value")), "key", "value")


@query(
    "table_diff",
    f"SELECT 'c_acctbal' AS column_name, {n('count(*)', 'rows_old')}, {n('count(*)', 'rows_new')}, {n('count_if(c_nationkey = 3)', 'mismatches')}, {r('max(CASE WHEN c_nationkey = 3 THEN 0.5 ELSE 0 END)', 'max_gap')} FROM customer UNION ALL SELECT 'c_mktsegment', {n('count(*)', 'rows_old')}, {n('count(*)', 'rows_new')}, {n('count_if(c_custkey % 10 = 0)', 'mismatches')}, NULL FROM customer",
)
def _(spark, sf):
    c = fx.table(spark, sf, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    new = c.withColumn("c_acctbal", F.when(F.col("c_nationkey") == 3, F.col("c_acctbal") + 0.5).otherwise(F.col("c_acctbal")))
    new = new.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, "OTHER").otherwise(F.col("c_mktsegment")))
    return vf.table_diff(c.drop("c_nationkey"), new.drop("c_nationkey"), ["c_custkey"])


@query(
    "headline_table",
    L + EV + f" SELECT 'n_rows' AS name, {r('count(*)', 'value')} FROM ev UNION ALL SELECT 'n_units', {r('count(DISTINCT pid)', 'value')} FROM ev UNION ALL SELECT 'first_year_shock', {r('avg(dlst) FILTER (age < 2)', 'value')} FROM ev UNION ALL SELECT 'oldest_age', {r('max(age)', 'value')} FROM ev UNION ALL SELECT 'greenness_first_year', {r('avg(dndvi) FILTER (age < 2)', 'value')} FROM ev",
)
def _(spark, sf):
    ev = event_post(spark, sf)
    young = F.col("age") < 2
    one = ev.agg(
        F.count(F.lit(1)).cast("double").alias("n_rows"), F.count_distinct("pid").cast("double").alias("n_units"), F.avg(F.when(young, F.col("dlst"))).alias("first_year_shock"),
        F.max("age").alias("oldest_age"), F.avg(F.when(young, F.col("dndvi"))).alias("greenness_first_year"),
    )
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in one.columns])))
