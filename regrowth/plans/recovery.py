"""Queries for recovery clocks: fits, ratios, bootstrap intervals and form checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from regrowth.functions import columns as fc
from regrowth.functions.draws import POISSON_STEPS
from regrowth.operators import aggregate as ag
from regrowth.operators import binning as bn
from regrowth.operators import bootstrap as bt
from regrowth.operators import fitting as ft
from regrowth.operators import quantiles as qt
from regrowth.operators import reshape as rs
from regrowth.operators.replicates import replicate_sums
from regrowth.plans import fixtures as fx
from regrowth.plans.registry import n, query, r
from regrowth.plans.sources_and_panel import size_classes, strata_sql, usual_strata
from regrowth.session import materialise
from regrowth.plans.sql_fit import MELT, bins_sql, fit_sql

L = f"WITH {fx.LONG_SQL}\n"
POISSON_SQL = "(CASE " + " ".join(f"WHEN {{u}} < {p!r}::DOUBLE THEN {i}" for i, p in enumerate(POISSON_STEPS)) + " ELSE 8 END)"


def u_sql(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"


def poisson_sql(units: str, unit: str, n_boot: int, seed: str, out: str = "wt") -> str:
    u = u_sql(f"'{seed}-' || {unit} || '-' || rep")
    return f"{out} AS (SELECT {unit}, rep, w FROM (SELECT {unit}, rep, {POISSON_SQL.format(u='u')} AS w FROM (SELECT {unit}, rep, {u} AS u FROM ({units}), (SELECT unnest(range(1, {n_boot + 1})) AS rep))) WHERE w > 0)"


def multinomial_sql(units: str, unit: str, n_boot: int, seed: str, out: str = "wt") -> str:
    """Weights of N draws of N units: the draws are split over 8 slices of the units down a binary tree, then drawn in a slice.

    Eight slices serve up to 2**19 units, as in ``replicates.unit_slices``.
    """
    u = lambda parts: u_sql(f"'{seed}-' || {parts}")
    levels, t = [], out
    for level in range(3):
        prev = f"{t}_c{level}"
        span = 8 >> level  # slices below a node
        size = lambda lo, hi: f"(SELECT coalesce(sum(n), 0) FROM {t}_z WHERE slice >= {lo} AND slice < {hi})"  # noqa: E731, B023
        levels.append(
            f"{t}_p{level} AS (SELECT node, {size(f'node * {span}', f'node * {span} + {span // 2}')}::DOUBLE / nullif({size(f'node * {span}', f'(node + 1) * {span}')}, 0) AS p FROM (SELECT DISTINCT node FROM {prev})),\n"
            f"{t}_d{level} AS (SELECT rep, node, m, p, k, exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + k * ln(p) + (m - k) * ln(1 - p)) AS f FROM (SELECT rep, node, m, p, unnest(range(0, m + 1)) AS k FROM {prev} JOIN {t}_p{level} USING (node) WHERE p > 0 AND p < 1)),\n"
            f"{t}_q{level} AS (SELECT rep, node, min(k) AS k FROM (SELECT rep, node, k, sum(f) OVER (PARTITION BY rep, node ORDER BY k) AS below FROM {t}_d{level}) WHERE below >= {u(f"'split-{level}-' || node || '-' || rep")} GROUP BY 1, 2),\n"
            f"{t}_l{level} AS (SELECT rep, node, m, coalesce(k, CASE WHEN p >= 1 THEN m ELSE 0 END) AS k FROM {prev} LEFT JOIN {t}_q{level} USING (rep, node) LEFT JOIN {t}_p{level} USING (node)),\n"
            f"{t}_c{level + 1} AS (SELECT rep, 2 * node AS node, k AS m FROM {t}_l{level} UNION ALL SELECT rep, 2 * node + 1, m - k FROM {t}_l{level})"
        )
    return (
        f"{t}_u AS (SELECT {unit}, ('0x' || substr(md5({unit}::VARCHAR), 1, 8))::UBIGINT % 8 AS slice FROM ({units})),\n"
        f"{t}_r AS (SELECT {unit}, CAST(slice AS BIGINT) AS slice, row_number() OVER (PARTITION BY slice ORDER BY md5({unit}::VARCHAR), {unit}::VARCHAR) - 1 AS rk FROM {t}_u),\n"
        f"{t}_z AS (SELECT slice, count(*) AS n FROM {t}_r GROUP BY 1),\n"
        f"{t}_c0 AS (SELECT rep, 0::BIGINT AS node, (SELECT count(*) FROM {t}_r) AS m FROM (SELECT unnest(range(1, {n_boot + 1})) AS rep)),\n"
        + ",\n".join(levels)
        + f",\n{t}_k AS (SELECT rep, node AS slice, CAST(floor({u("rep || '-' || node || '-' || j")} * n) AS BIGINT) AS rk FROM (SELECT rep, node, n, unnest(range(0, m)) AS j FROM {t}_c3 JOIN {t}_z ON node = slice)),\n"
        + f"{t} AS (SELECT {unit}, rep, count(*) AS w FROM {t}_k JOIN {t}_r USING (slice, rk) GROUP BY 1, 2)"
    )


def event_post(spark, sf):
    return fx.post_panel(spark, sf).where(F.col("src") == "event")


EV = ", ev AS (SELECT * FROM post WHERE src = 'event')"
FIT_COLS = f"{r('amp', 'amp', 3)}, {r('tau', 'tau', 3)}, {r('amp_se', 'amp_se', 3)}, {r('tau_se', 'tau_se', 3)}, {n('n_bins', 'n_bins')}"


@query("recovery_fit", L + EV + ",\n" + fit_sql(bins_sql("ev", "", "dlst", 12), "", "f") + f" SELECT {FIT_COLS} FROM f", 3)
def _(spark, sf):
    f = ft.recovery_fit(event_post(spark, sf).withColumn("one", F.lit(0)), ["one"], "dlst")
    return f.select("amp", "tau", "amp_se", "tau_se", "n_bins")


STRATUM_ROWS = 100  # the method's least rows of a stratum, whatever the measure


def strata_panel(spark, sf):
    """Rows by stratum, of strata with enough rows."""
    rows = bn.strata_rows(fx.post_panel(spark, sf), usual_strata())
    large = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= STRATUM_ROWS)
    return rows.join(large.select("stratum"), "stratum", "left_semi")


def strata_measures(spark, sf):
    return bn.long_measures(strata_panel(spark, sf), ["dlst", "dndvi"])


LARGE = f"SELECT stratum FROM ({strata_sql('post')}) GROUP BY 1 HAVING count(*) >= {STRATUM_ROWS}"
STRATA_FIT = ", " + MELT + f", st AS (SELECT * FROM ({strata_sql('ml')}) WHERE stratum IN ({LARGE})),\n" + fit_sql(bins_sql("st", "stratum, measure", "y", 10), "stratum, measure", "f")


@query("strata_fits", L + STRATA_FIT + f" SELECT stratum, measure, {FIT_COLS} FROM f", 3)
def _(spark, sf):
    f = ft.fit_bins(ft.binned_sums(strata_measures(spark, sf), ["stratum", "measure"], "y"), ["stratum", "measure"])
    return f.select("stratum", "measure", "amp", "tau", "amp_se", "tau_se", "n_bins")


@query("tau_ratio", L + STRATA_FIT + f" SELECT a.stratum, {r('a.tau', 'tau_a', 3)}, {r('a.tau_se', 'se_a', 3)}, {r('b.tau', 'tau_b', 3)}, {r('b.tau_se', 'se_b', 3)}, {r('a.tau / b.tau', 'ratio', 3)} FROM f a JOIN f b USING (stratum) WHERE a.measure = 'dlst' AND b.measure = 'dndvi'", 3)
def _(spark, sf):
    f = ft.fit_bins(ft.binned_sums(strata_measures(spark, sf), ["stratum", "measure"], "y"), ["stratum", "measure"])
    return ft.ratio_of_fits(f, ["stratum"], "measure", "dlst", "dndvi")


@query("half_lives", L + STRATA_FIT + f" SELECT stratum, measure, {r('tau * ln(2)', 't50', 3)}, {r('tau * ln(10)', 't90', 3)} FROM f", 3)
def _(spark, sf):
    f = ft.fit_bins(ft.binned_sums(strata_measures(spark, sf), ["stratum", "measure"], "y"), ["stratum", "measure"])
    return ft.half_lives(f).select("stratum", "measure", "t50", "t90")


@query("dissipated_fraction", L + STRATA_FIT + f", a AS (SELECT unnest([5.0::DOUBLE, 10, 15, 20]) AS at_age) SELECT stratum, {r('at_age', 'at_age', 3)}, {r('100 * (1 - exp(-at_age / tau))', 'dissipated_pct', 3)} FROM f, a WHERE measure = 'dlst'", 3)
def _(spark, sf):
    f = ft.fit_bins(ft.binned_sums(strata_panel(spark, sf), ["stratum"], "dlst"), ["stratum"])
    return ft.dissipated(f, [5.0, 10.0, 15.0, 20.0]).select("stratum", "at_age", "dissipated_pct")


# ---------------- bootstrap ----------------

BOOT = bt.REPLICATES["clocks"]
UNIT_SUMS = ", " + MELT.replace("FROM post", "FROM ev") + ", us AS (SELECT pid, measure, bin, count(*) AS n, sum(y) AS s1, sum(y * y) AS s2 FROM ml GROUP BY ALL)"


def cell_sql(keys: str, source: str = "us", weights: str = "wt") -> str:
    return (
        f"(SELECT rep, {keys}, sum(w * n) AS n, sum(w * s1) / sum(w * n) AS mean, CASE WHEN sum(w * n) > 1 THEN sqrt(greatest((sum(w * s2) - sum(w * n) * power(sum(w * s1) / sum(w * n), 2)) / (sum(w * n) - 1), 0) / sum(w * n)) END AS se "
        f"FROM {source} JOIN {weights} USING (pid) GROUP BY rep, {keys})"
    )


def boot_bins(keys: str, source: str = "us") -> str:
    return (
        f"SELECT rep, {keys.replace(', bin', '').replace('bin', '1 AS one')}, 0.6::DOUBLE + (bin + 0.5::DOUBLE) AS t, mean AS m, power(greatest(se, 1e-3::DOUBLE), -2.0) AS w, n FROM {cell_sql(keys, source)} WHERE n >= 10 AND se IS NOT NULL"
    )


BAND = f"{n('count(tau)', 'n_boot')}, {r('avg(tau)', 'boot_mean', 2)}, {r('quantile_cont(tau, 0.025)', 'lo', 2)}, {r('quantile_cont(tau, 0.975)', 'hi', 2)}"


@query(
    "cluster_bootstrap",
    L + EV + UNIT_SUMS + ",\n" + poisson_sql("SELECT DISTINCT pid FROM ev", "pid", BOOT, "c") + ",\n" + fit_sql(boot_bins("measure, bin"), "rep, measure", "f") + f" SELECT measure, {BAND}, {r('avg(CASE WHEN tau > 8 THEN 1.0 ELSE 0.0 END)', 'p_gt', 2)} FROM f GROUP BY 1",
    2,
)
def _(spark, sf):
    return bt.interval(boot_fits(spark, sf, "c", "poisson"), ["measure"], "tau", centre=8.0)


def boot_fits(spark, sf, seed: str, scheme: str):
    ev = event_post(spark, sf).withColumn("bin", bn.age_bin())
    sums = bt.unit_sums(bn.long_measures(ev, ["dlst", "dndvi"]), "pid", ["measure", "bin"], "y")
    cells = bt.replicate_cells(sums, "pid", ["measure", "bin"], BOOT, seed, scheme).withColumn("centre", bn.bin_centre())
    return ft.fit_bins(cells, ["rep", "measure"])


@query(
    "multinomial_weights",
    L + EV + ",\n" + multinomial_sql("SELECT DISTINCT pid FROM ev", "pid", BOOT, "m") + f", sm AS (SELECT pid, count(*) AS n, sum(dlst) AS s FROM ev GROUP BY 1) SELECT rep, {n('sum(w)', 'draws')}, {n('count(*)', 'n_units')}, {r('sum(w * s) / sum(w * n)', 'mean')} FROM sm JOIN wt USING (pid) GROUP BY 1",
)
def _(spark, sf):
    ev = event_post(spark, sf)
    reps = replicate_sums(bt.unit_sums(ev, "pid", [], "dlst"), "pid", [], ["n", "s1"], BOOT, "m")
    return reps.select("rep", "draws", "n_units", (F.col("s1") / F.col("n")).alias("mean"))


@query(
    "recovery_clock_ci",
    L + EV + UNIT_SUMS + ",\n" + multinomial_sql("SELECT DISTINCT pid FROM ev", "pid", BOOT, "k") + ",\n" + fit_sql(boot_bins("measure, bin"), "rep, measure", "f")
    + f", pr AS (SELECT a.tau / b.tau AS ratio, (a.tau - b.tau) * ln(2) AS lag FROM f a JOIN f b USING (rep) WHERE a.measure = 'dlst' AND b.measure = 'dndvi') SELECT {n('count(*)', 'n_boot')}, {r('avg(ratio)', 'ratio', 3)}, {r('quantile_cont(ratio, 0.025)', 'ratio_lo', 3)}, {r('quantile_cont(ratio, 0.975)', 'ratio_hi', 3)}, {r('avg(CASE WHEN ratio > 1 THEN 1.0 ELSE 0.0 END)', 'p_gt1', 3)}, {r('avg(lag)', 'lag_t50', 3)} FROM pr",
    3,
)
def _(spark, sf):
    pick = lambda m: F.max(F.when(F.col("measure") == m, F.col("tau")))
    pairs = boot_fits(spark, sf, "k", "multinomial").groupBy("rep").agg(pick("dlst").alias("a"), pick("dndvi").alias("b"))
    pairs = pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select((F.col("a") / F.col("b")).alias("ratio"), ((F.col("a") - F.col("b")) * F.log(F.lit(2.0))).alias("lag"))
    return pairs.agg(
        F.count(F.lit(1)).alias("n_boot"), F.avg("ratio").alias("ratio"), F.percentile("ratio", F.lit(0.025)).alias("ratio_lo"),
        F.percentile("ratio", F.lit(0.975)).alias("ratio_hi"), F.avg(F.when(F.col("ratio") > 1, 1.0).otherwise(0.0)).alias("p_gt1"), F.avg("lag").alias("lag_t50"),
    )


@query(
    "strata_bootstrap",
    L + ", " + MELT + f", st AS ({strata_sql('ml')}), us AS (SELECT pid, stratum, measure, bin, count(*) AS n, sum(y) AS s1, sum(y * y) AS s2 FROM st GROUP BY ALL),\n"
    + poisson_sql("SELECT DISTINCT pid FROM post", "pid", bt.REPLICATES["strata"], "s") + ",\n" + fit_sql(boot_bins("stratum, measure, bin"), "rep, stratum, measure", "f") + f" SELECT stratum, measure, {BAND} FROM f GROUP BY 1, 2 HAVING count(tau) > 20",
    2,
)
def _(spark, sf):
    p = fx.post_panel(spark, sf)
    rows = bn.long_measures(bn.strata_rows(p.withColumn("bin", bn.age_bin()), usual_strata()), ["dlst", "dndvi"])
    sums = bt.unit_sums(rows, "pid", ["stratum", "measure", "bin"], "y")
    cells = bt.poisson_cells(sums, "pid", ["stratum", "measure", "bin"], bt.REPLICATES["strata"], "s").withColumn("centre", bn.bin_centre())
    return bt.interval(ft.fit_bins(cells, ["rep", "stratum", "measure"]), ["stratum", "measure"], "tau", least=21).drop("p_gt")


# ---------------- forms, leaving periods out, remaining share ----------------


@query("model_selection")
def _(spark, sf):
    bins = ft.binned_sums(strata_measures(spark, sf).where(F.col("stratum").isin("all", "hansen")).withColumn("case", F.concat_ws("_", "stratum", "measure")), ["case"], "y")
    return ft.compare_forms(bins, "case", 12)


CORE = """, b AS (SELECT measure, 0.6::DOUBLE + (bin + 0.5::DOUBLE) AS t, avg(y) AS m, power(greatest(stddev_samp(y) / sqrt(count(y)), 1e-3::DOUBLE), -2.0) AS w FROM ml WHERE src = 'event' GROUP BY measure, bin HAVING count(y) >= 12),
  x AS (SELECT measure, 'linear' AS form, t AS x, m, w FROM b UNION ALL SELECT measure, 'logarithmic', ln(t), m, w FROM b),
  c AS (SELECT measure, form, sum(w * x) / sum(w) AS mx, sum(w * m) / sum(w) AS mm FROM x GROUP BY ALL),
  l AS (SELECT measure, form, count(*) AS nb, sum(w * (m - mm) * (m - mm)) AS sst, sum(w * (m - mm) * (m - mm)) - power(sum(w * (x - mx) * (m - mm)), 2) / sum(w * (x - mx) * (x - mx)) AS chi2 FROM x JOIN c USING (measure, form) GROUP BY ALL),
  e AS (SELECT measure, 'exponential' AS form, count(*) AS nb, any_value(sst) AS sst, sum(w * power(m - amp * exp(-t / tau), 2)) AS chi2 FROM b JOIN f USING (measure) JOIN (SELECT measure, sst FROM l WHERE form = 'linear') USING (measure) GROUP BY ALL),
  z AS (SELECT * FROM l UNION ALL SELECT * FROM e)"""


@query(
    "model_selection_core",
    L + ", " + MELT + ",\n" + fit_sql("SELECT measure, t, m, w, n FROM (" + bins_sql("ml", "measure", "y", 12).replace("WHERE y IS NOT NULL", "WHERE y IS NOT NULL AND src = 'event'") + ")", "measure", "f") + CORE
    + f" SELECT measure, form, {n('nb', 'n_bins')}, {r('chi2', 'chi2', 3)}, {r('1 - chi2 / sst', 'r2_w', 3)}, {r('chi2 + 4 + 12.0 / (nb - 3)', 'aicc', 3)} FROM z",
    3,
)
def _(spark, sf):
    """The two-parameter forms whose chi-square has a SQL twin."""
    rows = bn.long_measures(event_post(spark, sf), ["dlst", "dndvi"])
    forms = ft.compare_forms(ft.binned_sums(rows, ["measure"], "y"), "measure", 12)
    return forms.where(F.col("form").isin("linear", "logarithmic", "exponential")).select("measure", "form", "n_bins", "chi2", "r2_w", "aicc")


@query(
    "offset_fit",
    L + EV + f""", b AS (SELECT 0.6::DOUBLE + (bin + 0.5::DOUBLE) AS t, avg(dlst) AS m, power(greatest(stddev_samp(dlst) / sqrt(count(*)), 1e-3::DOUBLE), -2.0) AS w FROM ev GROUP BY bin HAVING count(*) >= 12),
    g AS (SELECT 0.3::DOUBLE + i * 0.05::DOUBLE AS tau FROM (SELECT unnest(range(0, 1195)) AS i)),
    s AS (SELECT tau, count(*) AS n_bins, sum(w) AS s1, sum(w * exp(-t / tau)) AS se, sum(w * exp(-t / tau) * exp(-t / tau)) AS see, sum(w * m) AS sm, sum(w * m * exp(-t / tau)) AS sem, sum(w * m * m) AS smm FROM b, g GROUP BY 1),
    q AS (SELECT tau, n_bins, (sem * s1 - sm * se) / (see * s1 - se * se) AS amp, (see * sm - se * sem) / (see * s1 - se * se) AS off, smm, sem, sm FROM s WHERE see * s1 - se * se > 0),
    z AS (SELECT *, smm - amp * sem - off * sm AS chi2 FROM q WHERE abs(amp) <= 25 AND abs(off) <= 10)
    SELECT {r('tau', 'tau', 4)}, {r('amp', 'amp', 4)}, {r('off', '"offset"', 4)}, {r('chi2', 'chi2', 4)}, {n('n_bins', 'n_bins')}, false AS on_bound FROM z ORDER BY round(chi2, 9), tau LIMIT 1""",
    4,
)
def _(spark, sf):
    bins = ft.binned_sums(event_post(spark, sf).withColumn("one", F.lit(0)), ["one"], "dlst")
    return ft.offset_fit(bins, ["one"]).drop("one")


MF = """, b AS (SELECT stratum, 0.6::DOUBLE + (bin + 0.5::DOUBLE) AS t, count(dlst) AS n, avg(dlst) AS m, greatest(stddev_samp(dlst) / sqrt(count(dlst)), 1e-3::DOUBLE) AS se FROM st GROUP BY stratum, bin HAVING count(dlst) >= 12),
  a AS (SELECT stratum, arg_min({t: t, m: m, se: se, n: n}, round(abs(t - 1.1), 9) * 1000 + t / 1000) AS a, arg_min({t: t, m: m, se: se, n: n}, round(abs(t - 10.1), 9) * 1000 + t / 1000) AS z, count(*) AS k FROM b GROUP BY 1),
  q AS (SELECT *, z.m / a.m AS rem, abs(z.m / a.m) * sqrt(power(z.se / z.m, 2) + power(a.se / a.m, 2)) AS e FROM a WHERE k >= 3 AND abs(z.t - 10.1) <= 1.0)"""


@query("model_free_fraction", L + f", st AS ({strata_sql('post')})" + MF + f" SELECT stratum, {r('a.t', 'age_ref')}, {r('z.t', 'age_later')}, {r('a.m', 'mean_ref')}, {r('z.m', 'mean_later')}, {n('a.n', 'n_ref')}, {n('z.n', 'n_later')}, {r('rem', 'remaining')}, {r('100 * (1 - rem)', 'dissipated_pct')}, {r('100 * (1 - rem - 1.96 * e)', 'ci_lo')}, {r('100 * (1 - rem + 1.96 * e)', 'ci_hi')} FROM q")
def _(spark, sf):
    rows = bn.strata_rows(fx.post_panel(spark, sf), usual_strata())
    return ft.model_free_fraction(ft.binned_sums(rows, ["stratum"], "dlst"), ["stratum"])


@query(
    "leave_one_period_out",
    L + EV + ", ep AS (SELECT DISTINCT epoch AS left_out FROM lp), lo AS (SELECT left_out, ev.* FROM ev JOIN ep ON ev.epoch <> ep.left_out),\n" + fit_sql(bins_sql("lo", "left_out", "dlst", 12), "left_out", "f") + f" SELECT left_out, {r('tau', 'tau', 3)}, {r('amp', 'amp', 3)} FROM f WHERE left_out IN (SELECT left_out FROM lo WHERE dlst IS NOT NULL GROUP BY 1 HAVING count(*) >= 80)",
    3,
)
def _(spark, sf):
    ev = event_post(spark, sf)
    others = F.array_except(F.array(*[F.lit(p) for p in fx.PERIODS]), F.array("epoch"))
    rows = ev.withColumn("left_out", F.explode(others))  # a row serves every refit that keeps its period
    return ft.recovery_fit(rows, ["left_out"], "dlst").select("left_out", "tau", "amp")


REM = ", pr AS (SELECT * FROM ev WHERE dlst IS NOT NULL AND dndvi IS NOT NULL), b AS (SELECT bin, count(*) AS n, avg(dlst) AS t, avg(dndvi) AS g FROM pr GROUP BY 1 HAVING count(*) >= 12), z AS (SELECT bin, t / (SELECT t FROM b WHERE bin = 0) AS thermal, g / (SELECT g FROM b WHERE bin = 0) AS green FROM b)"


@query("remaining_curve", L + EV + REM + f" SELECT {n('bin', 'bin')}, {r('thermal', 'thermal')}, {r('green', 'greenness')}, {r('thermal - green', 'gap')} FROM z")
def _(spark, sf):
    b = paired_bins(spark, sf)
    return wide_remaining(ft.share_of_first(b, ["measure"]), ["bin"])


def paired_rows(spark, sf):
    ev = fx.post_panel(spark, sf).where((F.col("src") == "event") & F.col("dlst").isNotNull() & F.col("dndvi").isNotNull())
    return ev.withColumn("bin", bn.floor_bin())


def paired_bins(spark, sf):
    rows = bn.long_measures(paired_rows(spark, sf), ["dlst", "dndvi"])
    return ag.mean_se(rows, ["measure", "bin"], "y", 12)


def wide_remaining(shares, keys):
    pick = lambda m: F.max(F.when(F.col("measure") == m, F.col("remaining")))
    g = shares.groupBy(*keys).agg(pick("dlst").alias("thermal"), pick("dndvi").alias("greenness"))
    return g.withColumn("gap", F.col("thermal") - F.col("greenness"))


@query(
    "remaining_curve_ci",
    L + EV + ", " + MELT.replace("FROM post WHERE", "FROM ev WHERE dlst IS NOT NULL AND dndvi IS NOT NULL AND") + ", us AS (SELECT pid, measure, CAST(floor(age - 0.6::DOUBLE) AS BIGINT) AS bin, count(*) AS n, sum(y) AS s1, sum(y * y) AS s2 FROM ml GROUP BY ALL),\n"
    + poisson_sql("SELECT DISTINCT pid FROM us", "pid", bt.REPLICATES["event"], "r") + f", cb AS (SELECT * FROM {cell_sql('measure, bin')} WHERE n >= 12), z AS (SELECT rep, cb.measure, cb.bin, cb.mean / f.mean AS rem FROM cb JOIN cb f USING (rep, measure) WHERE f.bin = 0), w AS (SELECT rep, bin, max(rem) FILTER (measure = 'dlst') - max(rem) FILTER (measure = 'dndvi') AS gap FROM z GROUP BY 1, 2) SELECT {n('bin', 'bin')}, {n('count(gap)', 'n_boot')}, {r('avg(gap)', 'boot_mean', 5)}, {r('quantile_cont(gap, 0.025)', 'lo', 5)}, {r('quantile_cont(gap, 0.975)', 'hi', 5)}, {r('avg(CASE WHEN gap > 0 THEN 1.0 ELSE 0.0 END)', 'p_gt', 5)} FROM w WHERE gap IS NOT NULL GROUP BY 1 HAVING count(gap) >= 100",
    5,
)
def _(spark, sf):
    rows = paired_rows(spark, sf)
    sums = bt.unit_sums(bn.long_measures(rows, ["dlst", "dndvi"]), "pid", ["measure", "bin"], "y")
    cells = bt.poisson_cells(sums, "pid", ["measure", "bin"], bt.REPLICATES["event"], "r")
    gaps = wide_remaining(ft.share_of_first(cells, ["rep", "measure"]), ["rep", "bin"])
    return bt.interval(gaps, ["bin"], "gap", least=100)


NETA = ", pre AS (SELECT pid, avg(dlst) AS p FROM lp WHERE is_pre AND clean AND src = 'event' GROUP BY 1), na AS (SELECT ev.*, dlst - p AS net, p FROM ev JOIN pre USING (pid))"


@query(
    "net_anomaly",
    L + EV + NETA + f" SELECT {n('floor(age - 0.6::DOUBLE)', 'bin')}, {n('count(*)', 'n')}, {n('count(DISTINCT year)', 'n_cohorts')}, {r('avg(dlst)', 'raw')}, {r('avg(net)', 'net')}, {r('avg(p) / avg(dlst)', 'pre_share')} FROM na GROUP BY 1 HAVING count(*) >= 12",
)
def _(spark, sf):
    lp = fx.long_panel(spark, sf).where((F.col("src") == "event") & F.col("clean"))
    pre = rs.pre_mean(lp, "pid", "dlst", F.col("is_pre"))
    post = lp.where(fc.after_event()).join(pre, "pid").withColumn("net", F.col("dlst") - F.col("reference")).withColumn("bin", bn.floor_bin())
    g = post.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("year").alias("n_cohorts"), F.avg("dlst").alias("raw"), F.avg("net").alias("net"), (F.avg("reference") / F.avg("dlst")).alias("pre_share")
    )
    return g.where(F.col("n") >= 12)


SEVM = """, sev AS (SELECT pid, avg(dndvi) AS sev FROM post WHERE age >= 0.6 AND age < 3.0 GROUP BY 1),
sm AS (SELECT CASE WHEN src = 'event' THEN 'landslide' ELSE 'annual_loss' END AS cls, CASE WHEN sev >= -1.0 AND sev < -0.30 THEN 'severe' WHEN sev >= -0.30 AND sev < -0.20 THEN 'high' WHEN sev >= -0.20 AND sev < -0.12 THEN 'moderate' WHEN sev >= -0.12 AND sev < 0 THEN 'light' END AS severity, post.* FROM post JOIN sev USING (pid)),
gt AS (SELECT severity, cls FROM sm WHERE severity IS NOT NULL GROUP BY ALL HAVING count(DISTINCT pid) >= 60), sg AS (SELECT sm.* FROM sm JOIN gt USING (severity, cls)),\n"""
SEVERITY = [("severe", -1.0, -0.30), ("high", -0.30, -0.20), ("moderate", -0.20, -0.12), ("light", -0.12, 0.0)]  # fixed values


@query(
    "severity_match",
    L + SEVM + fit_sql(bins_sql("sg", "severity, cls", "dlst", 10), "severity, cls", "f") + f" SELECT severity, cls, {r('amp', 'amp', 3)}, {r('tau', 'tau', 3)}, {r('100 * (1 - exp(-10.0 / tau))', 'gone_10', 3)} FROM f",
    3,
)
def _(spark, sf):
    p = fx.post_panel(spark, sf)
    sev = p.where((F.col("age") >= 0.6) & (F.col("age") < 3.0)).groupBy("pid").agg(F.avg("dndvi").alias("sev"))
    rows = p.join(sev, "pid").withColumns({"cls": F.when(F.col("src") == "event", "landslide").otherwise("annual_loss"), "severity": bn.band_of("sev", SEVERITY)})
    rows = rows.where(F.col("severity").isNotNull())
    enough = rows.groupBy("severity", "cls").agg(F.count_distinct("pid").alias("u")).where(F.col("u") >= 60)
    f = ft.fit_bins(ft.binned_sums(rows.join(enough, ["severity", "cls"], "left_semi"), ["severity", "cls"], "dlst"), ["severity", "cls"])
    return f.select("severity", "cls", "amp", "tau", (100 * (1 - F.exp(-10.0 / F.col("tau")))).alias("gone_10"))


ERA = """, g AS (SELECT yr <= 1998 AS early, min(age) AS lo, max(age) AS hi FROM ev GROUP BY 1), cw AS (SELECT max(lo) AS lo, min(hi) AS hi FROM g),
er AS (SELECT 'all' AS part, * FROM ev UNION ALL SELECT 'early', * FROM ev WHERE yr <= 1998 UNION ALL SELECT 'late', * FROM ev WHERE yr > 1998
  UNION ALL SELECT 'all_common', ev.* FROM ev, cw WHERE age BETWEEN cw.lo AND cw.hi UNION ALL SELECT 'early_common', ev.* FROM ev, cw WHERE yr <= 1998 AND age BETWEEN cw.lo AND cw.hi
  UNION ALL SELECT 'late_common', ev.* FROM ev, cw WHERE yr > 1998 AND age BETWEEN cw.lo AND cw.hi),\n"""


@query("era_compare", L + EV + ERA + fit_sql(bins_sql("er", "part", "dlst", 10), "part", "f") + f" SELECT part, {n('n_rows', 'n_rows')}, {r('amp', 'amp', 3)}, {r('tau', 'tau', 3)}, {n('n_bins', 'n_bins')} FROM f JOIN (SELECT part, count(*) AS n_rows FROM er GROUP BY 1) USING (part)", 3)
def _(spark, sf):
    ev = event_post(spark, sf)
    early = F.col("yr") <= 1998
    lo, hi = bn.common_support(ev, early, "age")
    ev = ev.withColumns({"_lo": lo, "_hi": hi})
    shared = (F.col("age") >= F.col("_lo")) & (F.col("age") <= F.col("_hi"))
    parts = [("all", F.lit(True)), ("early", early), ("late", ~early), ("all_common", shared), ("early_common", early & shared), ("late_common", ~early & shared)]
    rows = bn.strata_rows(ev, parts, "part")
    return ft.fit_bins(ft.binned_sums(rows, ["part"], "dlst"), ["part"]).select("part", "n_rows", "amp", "tau", "n_bins")


@query(
    "area_strata",
    L + EV + ", q AS (SELECT quantile_cont(area_ha, 1/3.0::DOUBLE) AS q1, quantile_cont(area_ha, 2/3.0::DOUBLE) AS q2 FROM ev), sc AS (SELECT CASE WHEN area_ha < q1 THEN 'small' WHEN area_ha < q2 THEN 'medium' ELSE 'large' END AS cls, ev.* FROM ev, q),\n"
    + fit_sql(bins_sql("sc", "cls", "dlst", 10), "cls", "f") + f" SELECT cls, {r('tau', 'tau', 3)}, {r('med_area', 'med_area', 3)}, {r('med_elev', 'med_elev', 3)} FROM f JOIN (SELECT cls, median(area_ha) AS med_area, median(elev) AS med_elev FROM sc GROUP BY 1) USING (cls)",
    3,
)
def _(spark, sf):
    rows = size_classes(event_post(spark, sf))
    f = ft.fit_bins(ft.binned_sums(rows, ["cls"], "dlst"), ["cls"]).select("cls", "tau")
    return f.join(qt.medians(rows, ["cls"], "area_ha", "med_area"), "cls").join(qt.medians(rows, ["cls"], "elev", "med_elev"), "cls")


@query("era_cohort_mix", L + EV + f" SELECT CASE WHEN yr <= 1998 THEN 'early' ELSE 'late' END AS part, year, {n('count(*)', 'n')} FROM ev WHERE age >= 10 GROUP BY 1, 2 HAVING count(*) >= 50")
def _(spark, sf):
    tail = event_post(spark, sf).where(F.col("age") >= 10)
    g = tail.groupBy(F.when(F.col("yr") <= 1998, "early").otherwise("late").alias("part"), "year").agg(F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= 50)


@query("mixed_fit", L + ", " + MELT + ",\n" + fit_sql(bins_sql("ml", "measure", "y", 10), "measure", "f") + f" SELECT measure, {r('amp', 'amp', 3)}, {r('tau', 'tau', 3)}, {n('n_bins', 'n_bins')} FROM f", 3)
def _(spark, sf):
    """Both sources pooled."""
    rows = bn.long_measures(fx.post_panel(spark, sf), ["dlst", "dndvi"])
    return ft.fit_bins(ft.binned_sums(rows, ["measure"], "y"), ["measure"]).select("measure", "amp", "tau", "n_bins")


WIDE_BINS = "SELECT agent, 0.6::DOUBLE + (floor(bin / 2) + 0.5::DOUBLE) * 2 AS t, avg(y) AS m, power(greatest(stddev_samp(y) / sqrt(count(y)), 1e-3::DOUBLE), -2.0) AS w, count(y) AS n FROM (SELECT agent, bin, dndvi AS y FROM ev WHERE agent <> '' AND dndvi IS NOT NULL) GROUP BY agent, floor(bin / 2) HAVING count(y) >= 6"


@query("recovery_fit_loose", L + EV + ",\n" + fit_sql(WIDE_BINS, "agent", "f", 4) + f" SELECT agent, {r('amp', 'amp', 3)}, {r('tau', 'tau', 3)}, {n('n_bins', 'n_bins')} FROM f", 3)
def _(spark, sf):
    """Two-year bins with lower gates, for thin strata."""
    ev = ag.named_groups(event_post(spark, sf), "agent")
    f = ft.recovery_fit(ev, ["agent"], "dndvi", min_bin=6, min_bins=4, min_rows=60, step=2.0)
    return f.select("agent", "amp", "tau", "n_bins")


@query(
    "net_anomaly_fraction",
    L + EV + NETA + ", b AS (SELECT floor(age - 0.6::DOUBLE) AS bin, count(*) AS n, avg(net) AS m FROM na GROUP BY 1 HAVING count(*) >= 12) "
    + f"SELECT {n('bin', 'bin')}, {n('n', 'n')}, {r('m / (SELECT m FROM b WHERE bin = 0)', 'remaining')}, {r('100 * (1 - m / (SELECT m FROM b WHERE bin = 0))', 'dissipated_pct')} FROM b",
)
def _(spark, sf):
    lp = fx.long_panel(spark, sf).where((F.col("src") == "event") & F.col("clean"))
    pre = rs.pre_mean(lp, "pid", "dlst", F.col("is_pre"))
    post = lp.where(fc.after_event()).join(pre, "pid").withColumns({"net": F.col("dlst") - F.col("reference"), "bin": bn.floor_bin(), "case": F.lit("net")})
    share = ft.share_of_first(ag.mean_se(post, ["case", "bin"], "net", 12), ["case"])
    return share.select("bin", "n", "remaining", (100 * (1 - F.col("remaining"))).alias("dissipated_pct"))
