"""Queries for joins, matching, sampling, ranking and sequence functions, and spatial units."""

from __future__ import annotations

from pyspark.sql import functions as F

from regrowth.functions import columns as fc
from regrowth.operators import aggregate as ag
from regrowth.operators import binning as bn
from regrowth.operators import fixed_effects as fe
from regrowth.operators import matching as mt
from regrowth.operators import ranking as rk
from regrowth.operators import regression as rg
from regrowth.operators import reshape as rs
from regrowth.operators import spatial as sp
from regrowth.plans import fixtures as fx
from regrowth.plans.aggregates import GU, PAIR_SQL, SENSOR_SQL, grid_units, sensor_pairs, sensor_values
from regrowth.plans.registry import n, query, r

U, L = f"WITH {fx.UNIT_SQL}\n", f"WITH {fx.LONG_SQL}\n"
P, S, G = f"WITH {fx.PIXEL_SQL}\n", f"WITH {fx.SCENE_SQL}\n", f"WITH {fx.GRID_SQL}\n"


def u_sql(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"


# ---------------- joins ----------------

PRE = ", pre AS (SELECT pid, avg(dlst) AS reference FROM lp WHERE is_pre GROUP BY 1)"


@query("inner_equi", L + PRE + f" SELECT pid, epoch, {r('dlst - reference', 'net')} FROM post JOIN pre USING (pid)")
def _(spark, sf):
    lp = fx.long_panel(spark, sf)
    pre = rs.pre_mean(lp, "pid", "dlst", F.col("is_pre"))
    return lp.where(fc.after_event()).join(pre, "pid").select("pid", "epoch", (F.col("dlst") - F.col("reference")).alias("net"))


SEV = ", sev AS (SELECT pid, avg(dndvi) AS sev FROM post WHERE age >= 0.6 AND age < 3.0 GROUP BY 1)"


@query("left_equi", L + SEV + f" SELECT pid, epoch, {r('sev', 'sev')} FROM post LEFT JOIN sev USING (pid)")
def _(spark, sf):
    p = fx.post_panel(spark, sf)
    sev = p.where((F.col("age") >= 0.6) & (F.col("age") < 3.0)).groupBy("pid").agg(F.avg("dndvi").alias("sev"))
    return p.join(sev, "pid", "left").select("pid", "epoch", "sev")


@query("dim_lookup", f"SELECT n_name, r_name, {n('count(*)', 'n')} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def _(spark, sf):
    # no broadcast hint: the planner broadcasts a dimension when its measured size is below the threshold
    c = fx.table(spark, sf, "customer", ["c_nationkey"]).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    nat = fx.table(spark, sf, "nation")
    reg = fx.table(spark, sf, "region")
    return c.join(nat, c["c_nationkey"] == nat["n_nationkey"]).join(reg, nat["n_regionkey"] == reg["r_regionkey"]).select("n_name", "r_name", "n")


KEEP = ", keep AS (SELECT pid FROM post GROUP BY 1 HAVING count(*) >= 4 AND max(age) - min(age) >= 4), fe AS (SELECT * FROM post WHERE pid IN (SELECT pid FROM keep))"


@query("semi_join", L + KEEP + f" SELECT pid, {n('count(*)', 'n')}, {r('avg(dlst)', 'dlst')} FROM fe GROUP BY 1")
def _(spark, sf):
    kept = fe.long_enough(fx.post_panel(spark, sf), "pid")
    return kept.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.avg("dlst").alias("dlst"))


@query("anti_join", U + f"SELECT coalesce(agent, '?') AS agent, {n('count(*)', 'n')}, {r('sum(area_ha)', 'area_ha')} FROM unit WHERE agent IS NULL OR agent NOT IN ('typhoon_rain', 'rainfall', 'earthquake') GROUP BY 1")
def _(spark, sf):
    u = fx.units(spark, sf)
    main = u.where(F.col("agent").isin("typhoon_rain", "rainfall", "earthquake")).select("agent").distinct()
    rest = u.join(main, "agent", "left_anti")
    return rest.groupBy(F.coalesce("agent", F.lit("?")).alias("agent")).agg(F.count(F.lit(1)).alias("n"), F.sum("area_ha").alias("area_ha"))


TILES = "tl AS (SELECT CAST(floor(\"row\" / 50) AS BIGINT) || '-' || CAST(floor(\"col\" / 50) AS BIGINT) AS tile, min(\"col\") - 0.5::DOUBLE AS west, max(\"col\") + 0.25::DOUBLE AS east, min(\"row\") - 0.5::DOUBLE AS south, max(\"row\") + 0.5::DOUBLE AS north FROM grid GROUP BY 1)"


@query("bbox_range_join", G + f", {TILES} SELECT tile, {n('count(*)', 'n')}, {r('avg(lst)', 'lst')} FROM grid JOIN tl ON \"col\" + slope / 100 >= west AND \"col\" + slope / 100 < east AND \"row\" >= south AND \"row\" < north GROUP BY 1")
def _(spark, sf):
    g = fx.pixel_grid(spark, sf)
    tile = F.concat_ws("-", F.floor(F.col("row") / 50), F.floor(F.col("col") / 50))
    boxes = g.groupBy(tile.alias("tile")).agg(
        (F.min("col") - 0.5).alias("west"), (F.max("col") + 0.25).alias("east"), (F.min("row") - 0.5).alias("south"), (F.max("row") + 0.5).alias("north")
    )
    hits = sp.points_in_boxes(g.withColumn("x", F.col("col") + F.col("slope") / 100), boxes, "x", "row", 50.0)
    return hits.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.avg("lst").alias("lst"))


FOOT = "ft AS (SELECT yr AS scene, min(\"row\") AS fr0, min(\"col\") + (yr - 1995) * 7 AS fc0, max(\"row\") - (yr - 1995) * 5 AS fr1, max(\"col\") AS fc1 FROM grid GROUP BY yr), wn AS (SELECT unit, min(\"row\") AS r0, min(\"col\") AS c0, max(\"row\") + 1 AS r1, max(\"col\") + 1 AS c1 FROM gu GROUP BY 1)"


@query("contained_in_footprint", G + f", {GU}, {FOOT} SELECT scene, {n('count(*)', 'n_units')} FROM wn JOIN ft ON r0 >= fr0 AND c0 >= fc0 AND r1 <= fr1 AND c1 <= fc1 GROUP BY 1")
def _(spark, sf):
    g = fx.pixel_grid(spark, sf)
    feet = g.groupBy(F.col("yr").alias("scene")).agg(
        F.min("row").alias("fr0"), (F.min("col") + (F.col("yr") - 1995) * 7).alias("fc0"), (F.max("row") - (F.col("yr") - 1995) * 5).alias("fr1"), F.max("col").alias("fc1")
    )
    win = grid_units(spark, sf).groupBy("unit").agg(F.min("row").alias("r0"), F.min("col").alias("c0"), (F.max("row") + 1).alias("r1"), (F.max("col") + 1).alias("c1"))
    return sp.windows_in_footprints(win, feet, 50).groupBy("scene").agg(F.count(F.lit(1)).alias("n_units"))


CAND = GU + """, pf AS (SELECT unit, count(*) AS n_px, avg(elev) AS pe, avg(slope) AS ps FROM gu GROUP BY 1),
cand AS (SELECT unit, i."row", i."col", min((i."row" - gu."row") * (i."row" - gu."row") + (i."col" - gu."col") * (i."col" - gu."col")) AS d2,
    any_value(abs(i.elev - pe)) AS de, any_value(abs(i.slope - ps)) AS ds
  FROM gu JOIN pf USING (unit) JOIN grid i ON NOT i.disturbed AND i."row" BETWEEN gu."row" - 50 AND gu."row" + 50 AND i."col" BETWEEN gu."col" - 50 AND gu."col" + 50
  WHERE abs(i.elev - pe) <= 250 AND abs(i.slope - ps) <= 15 GROUP BY 1, 2, 3),
far AS (SELECT *, d2 <= 900 AND de <= 150 AND ds <= 10 AS tier1 FROM cand WHERE d2 BETWEEN 16 AND 2500),
n1 AS (SELECT unit, count_if(tier1) AS n1 FROM far GROUP BY 1),
ctrl AS (SELECT far.*, n1 FROM far JOIN n1 USING (unit) WHERE tier1 OR n1 < 30)"""


def control_inputs(spark, sf):
    g = fx.pixel_grid(spark, sf)
    u = grid_units(spark, sf).select("unit", "row", "col")
    profile = sp.unit_profile(u, g.select("row", "col", "elev", "slope"), "unit", ["elev", "slope"])
    return u, profile, g.where(~F.col("disturbed"))


def controls(spark, sf, **limits):
    u, profile, intact = control_inputs(spark, sf)
    return u, sp.candidate_controls(u, profile, intact, "unit", **limits)


@query("control_match", G + f", {CAND} SELECT unit, {n('count(*)', 'n_ctrl')}, {n('min(d2)', 'nearest')}, {n('max(d2)', 'farthest')} FROM far WHERE tier1 GROUP BY 1")
def _(spark, sf):
    _, cand = controls(spark, sf, reach=30, d_elev=150.0, d_slope=10.0)
    close = cand.where(F.col("d2") >= 16)
    return close.groupBy("unit").agg(F.count(F.lit(1)).alias("n_ctrl"), F.min("d2").alias("nearest"), F.max("d2").alias("farthest"))


@query("tiered_match", G + f", {CAND} SELECT unit, {n('any_value(n1)', 'n_tier1')}, {n('count(*)', 'n_ctrl')}, {r('avg(de)', 'd_elev')} FROM ctrl GROUP BY 1")
def _(spark, sf):
    _, cand = controls(spark, sf)
    t = sp.tiered_sums(cand, "unit", ["d_elev"]).where(F.col("n_ctrl") > 0)
    return t.select("unit", "n_tier1", "n_ctrl", (F.col("d_elev") / F.col("n_ctrl")).alias("d_elev"))


OBS = "obs AS (SELECT CAST(floor(l_orderkey / 100) AS BIGINT) AS \"row\", l_orderkey % 100 AS \"col\", CAST(year(l_shipdate) AS BIGINT) AS period, avg(l_extendedprice / 1e5) AS value FROM lineitem GROUP BY ALL)"


def observations(spark, sf):
    li = fx.table(spark, sf, "lineitem", ["l_orderkey", "l_shipdate", "l_extendedprice"])
    return li.groupBy(
        F.floor(F.col("l_orderkey") / 100).cast("long").alias("row"), (F.col("l_orderkey") % 100).alias("col"), F.year("l_shipdate").cast("long").alias("period")
    ).agg(F.avg(F.col("l_extendedprice") / 1e5).alias("value"))


@query(
    "unit_minus_control",
    G + f""", {CAND}, {OBS}, roles AS (SELECT unit, "row", "col", true AS own FROM gu UNION ALL SELECT unit, "row", "col", false FROM ctrl),
    s AS (SELECT unit, period, count(value) FILTER (own) AS n_unit, count(value) FILTER (NOT own) AS n_ctrl, avg(value) FILTER (own) AS u, avg(value) FILTER (NOT own) AS c FROM roles JOIN obs USING ("row", "col") GROUP BY 1, 2)
    SELECT unit, period, {n('n_unit', 'n_unit')}, {n('n_ctrl', 'n_ctrl')}, {r('u - c', 'delta')} FROM s JOIN pf USING (unit) WHERE n_unit >= greatest(3, 0.3 * n_px) AND n_ctrl >= 20""",
)
def _(spark, sf):
    u, profile, intact = control_inputs(spark, sf)
    return sp.unit_minus_tiered(u, profile, intact, observations(spark, sf), "unit", "period", "value")


PREPOST = "SELECT pid, year, agent, elev, area_ha, src, max(dlst) FILTER (is_pre) AS pre_v, max(dlst) FILTER (yr = year + 1) AS post_v FROM lp WHERE is_pre OR yr = year + 1 GROUP BY ALL HAVING pre_v IS NOT NULL AND post_v IS NOT NULL"


@query("cohort_pre_post", L + f", c AS (SELECT pid, year, max(dlst) FILTER (yr = year - 1) AS pre_v, max(dlst) FILTER (yr = year + 1) AS post_v FROM lp WHERE yr IN (year - 1, year + 1) GROUP BY ALL) SELECT pid, year, {r('pre_v', 'pre_v')}, {r('post_v', 'post_v')} FROM c WHERE pre_v IS NOT NULL AND post_v IS NOT NULL")
def _(spark, sf):
    return mt.cohort_pre_post(fx.long_panel(spark, sf), "pid", "year", "yr", "dlst", [])




@query("sensor_pair", f"WITH {SENSOR_SQL}, {PAIR_SQL}, z AS (SELECT period, CASE WHEN grouping(size) = 1 THEN 'all' ELSE size END AS size, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(y, x) AS r FROM (SELECT *, CASE WHEN area_ha < 2 THEN 'lt2' WHEN area_ha < 10 THEN '2_10' ELSE 'ge10' END AS size FROM pr) GROUP BY GROUPING SETS ((period), (period, size))) SELECT period, size, {n('n', 'n')}, {r('slope', 'slope')}, {r('intercept', 'intercept')}, {r('r', 'r')} FROM z WHERE n >= 30")
def _(spark, sf):
    pairs = sensor_pairs(spark, sf)
    rows = bn.strata_rows(pairs, [("all", F.lit(True)), ("lt2", F.col("area_ha") < 2), ("2_10", (F.col("area_ha") >= 2) & (F.col("area_ha") < 10)), ("ge10", F.col("area_ha") >= 10)], "size")
    return ag.simple_regression(rows, ["period", "size"], "x", "y", 30).select("period", "size", "n", "slope", "intercept", "r")


CHAIN = f"""WITH {SENSOR_SQL},
q AS (SELECT a.sensor AS sa, b.sensor AS sb, period, regr_slope(a.value, b.value) AS slope, regr_intercept(a.value, b.value) AS intercept FROM sv a JOIN sv b USING (pid, period) GROUP BY ALL HAVING count(*) >= 30),
c1 AS (SELECT slope, intercept FROM q WHERE sa = 'A' AND sb = 'N'), c2 AS (SELECT slope, intercept FROM q WHERE sa = 'N' AND sb = 'R'),
p AS (SELECT period, avg(value) AS raw, stddev_samp(value) / sqrt(count(*)) AS se FROM sv WHERE sensor = 'A' GROUP BY 1),
lo AS (SELECT min(c1.slope) * (SELECT min(slope) FROM c2) AS den FROM c1),
e AS (SELECT period, raw, se, ((raw - c1.intercept) / c1.slope - c2.intercept) / c2.slope AS v FROM p, c1, c2)"""


def six(expr: str, alias: str) -> str:
    """SQL twin of ``six_digits``."""
    p = f"pow(10.0::DOUBLE, floor(log10(abs({expr}))) - 5)"
    return f"CASE WHEN ({expr}) = 0 THEN 0.0::DOUBLE ELSE round(({expr}) / {p}, 0) * {p} END AS {alias}"


def six_digits(c):
    """Six significant digits: a flat calibration line carries a value very far."""
    p = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))) - 5)
    return F.when(c == 0, 0.0).otherwise(F.round(c / p, 0) * p)


@query("calibration_chain", CHAIN + f" SELECT period, {n('count(*)', 'n_chains')}, {six('min(v)', 'eq_lo')}, {six('max(v)', 'eq_hi')}, {six('avg(v)', 'eq_mid')}, {r('any_value(se)', 'se')}, {six('any_value(se) / any_value(den)', 'se_eq')} FROM e, lo GROUP BY 1", 12)
def _(spark, sf):
    def lines(a, b):
        return ag.simple_regression(sensor_pairs(spark, sf, a, b), ["period"], "x", "y", 30).select("slope", "intercept")

    p = sensor_values(spark, sf).where(F.col("sensor") == "A").groupBy("period").agg(F.avg("value").alias("raw"), fc.standard_error("value").alias("se"))
    out = mt.chain_calibration(p, [lines("A", "N"), lines("N", "R")], "raw", "se", ["period"])
    return out.select("period", "n_chains", *[six_digits(F.col(c)).alias(c) for c in ("eq_lo", "eq_hi", "eq_mid")], F.round("se", 6).alias("se"), six_digits(F.col("se_eq")).alias("se_eq"))


@query("tolerance_match", f"SELECT s_suppkey, {n('count(*)', 'n')}, {r('avg(c_acctbal)', 'mean_bal', 4)} FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) <= 500 GROUP BY 1", 4)
def _(spark, sf):
    s = fx.table(spark, sf, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"]).withColumnRenamed("s_nationkey", "nat")
    c = fx.table(spark, sf, "customer", ["c_nationkey", "c_acctbal"]).withColumnRenamed("c_nationkey", "nat")
    out = mt.tolerance_sums(s, c, ["nat"], "s_suppkey", "s_acctbal", "c_acctbal", 500.0)
    return out.select("s_suppkey", "n", (F.col("total") / F.col("n")).alias("mean_bal"))


# ---------------- windows and sequences ----------------


@query("within_demean", L + f"SELECT pid, epoch, {r('dlst - avg(dlst) OVER (PARTITION BY pid)', 'dlst_w')} FROM post")
def _(spark, sf):
    return fe.within_demean(fx.post_panel(spark, sf), "pid", ["dlst"]).select("pid", "epoch", "dlst_w")


@query("top_k", U + f"SELECT agent, pid, n_px, {n('k', 'k')} FROM (SELECT agent, pid, n_px, row_number() OVER (PARTITION BY agent ORDER BY n_px DESC, pid) AS k FROM unit) WHERE k <= 5")
def _(spark, sf):
    u = fx.units(spark, sf).select("agent", "pid", "n_px")
    return rk.top_k_per_group(u, ["agent"], [F.desc("n_px"), F.col("pid")], 5, "k")


CURVE = ", cv AS (SELECT bin, count(*) AS n, avg(dlst) AS m FROM post GROUP BY 1 HAVING count(*) >= 10)"


@query("consecutive_diff", L + CURVE + f" SELECT {n('bin', 'bin')}, {r('abs(m - lag(m) OVER (ORDER BY bin))', 'gap')} FROM cv")
def _(spark, sf):
    from pyspark.sql import Window as W

    g = ag.mean_se(fx.post_panel(spark, sf).withColumn("bin", bn.age_bin()), [F.lit(0).alias("one"), "bin"], "dlst", 10)
    return g.select("bin", F.abs(F.col("mean") - F.lag("mean").over(W.partitionBy("one").orderBy("bin"))).alias("gap"))


PCURVE = ", pc AS (SELECT floor(chm) + 0.5::DOUBLE AS x, avg(lst) AS y FROM px WHERE chm >= 8 AND chm < 50 GROUP BY 1 HAVING count(*) >= 80)"


def height_curve(spark, sf):
    px = fx.pixel_sample(spark, sf).where((F.col("chm") >= 8) & (F.col("chm") < 50))
    return px.groupBy(F.lit(0).alias("one"), (F.floor("chm") + 0.5).alias("x")).agg(F.avg("lst").alias("y"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 80)


@query("local_slope", P + PCURVE + f""" SELECT {r('x', 'x')}, {r('CASE WHEN px_ IS NULL THEN (ny - y) / (nx - x) WHEN nx IS NULL THEN (y - py) / (x - px_) ELSE ((x - px_) * (x - px_) * ny + ((nx - x) * (nx - x) - (x - px_) * (x - px_)) * y - (nx - x) * (nx - x) * py) / ((x - px_) * (nx - x) * (nx - px_)) END', 'gradient')} FROM
  (SELECT x, y, lag(x) OVER (ORDER BY x) AS px_, lag(y) OVER (ORDER BY x) AS py, lead(x) OVER (ORDER BY x) AS nx, lead(y) OVER (ORDER BY x) AS ny FROM pc)""")
def _(spark, sf):
    return rg.numeric_gradient(height_curve(spark, sf), ["one"], "x", "y").select("x", "gradient")


@query("interp_at", P + PCURVE + f""", q AS (SELECT unnest([5.0::DOUBLE, 15, 20, 25.25, 30, 49.9]) AS x_at),
  b AS (SELECT x_at, max(x) FILTER (x <= x_at) AS x0, arg_max(y, x) FILTER (x <= x_at) AS y0, min(x) FILTER (x >= x_at) AS x1, arg_min(y, x) FILTER (x >= x_at) AS y1 FROM q, pc GROUP BY 1)
  SELECT {r('x_at', 'x_at')}, {r('CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (x_at - x0) / (x1 - x0) END', 'value')} FROM b""")
def _(spark, sf):
    return rg.interpolate(height_curve(spark, sf), ["one"], "x", "y", [5.0, 15.0, 20.0, 25.25, 30.0, 49.9]).drop("one")


@query("first_crossing", P + PCURVE + f" SELECT {r('min(x) FILTER (g * 10 > -0.3)', 'first_x')} FROM (SELECT x, (lead(y) OVER (ORDER BY x) - lag(y) OVER (ORDER BY x)) / 2 AS g FROM pc)")
def _(spark, sf):
    g = rg.numeric_gradient(height_curve(spark, sf), ["one"], "x", "y")
    g = g.where((F.col("x") > 8.5) & (F.col("x") < 49.5))
    return rg.first_where(g, ["one"], "x", F.col("gradient") * 10 > -0.3).select("first_x")


@query("nearest_bin", L + CURVE + f", c AS (SELECT 0.6::DOUBLE + bin + 0.5::DOUBLE AS t, m, n FROM cv) SELECT {r('a', 'target')}, {r('arg_min(t, round(abs(t - a), 9) * 1000 + t / 1000)', 'centre')}, {r('arg_min(m, round(abs(t - a), 9) * 1000 + t / 1000)', 'mean')} FROM c, (SELECT unnest([1.1::DOUBLE, 10.1::DOUBLE]) AS a) WHERE abs(t - a) <= 1.0 GROUP BY a")
def _(spark, sf):
    g = ag.mean_se(fx.post_panel(spark, sf).withColumn("bin", bn.age_bin()), ["bin"], "dlst", 10).withColumn("t", bn.bin_centre())
    rows = g.withColumn("target", F.explode(F.array(F.lit(1.1), F.lit(10.1)))).where(F.abs(F.col("t") - F.col("target")) <= 1.0)
    best = rows.groupBy("target").agg(F.min_by(F.struct("t", "mean"), F.struct(F.round(F.abs(F.col("t") - F.col("target")), 9), F.col("t"))).alias("b"))
    return best.select("target", F.col("b.t").alias("centre"), F.col("b.mean").alias("mean"))


@query("stratified_sample", U + f"SELECT agent, pid FROM (SELECT agent, pid, row_number() OVER (PARTITION BY agent ORDER BY {u_sql(chr(39) + 's-' + chr(39) + ' || pid')}, pid) AS k FROM unit) WHERE k <= 120")
def _(spark, sf):
    return rk.sample_per_stratum(fx.units(spark, sf).select("agent", "pid"), ["agent"], "pid", 120, "s")


@query("uniform_sample", f"SELECT o_orderkey FROM orders ORDER BY {u_sql(chr(39) + 'x-' + chr(39) + ' || o_orderkey')}, o_orderkey LIMIT 4000")
def _(spark, sf):
    return rk.exact_sample(fx.table(spark, sf, "orders", ["o_orderkey"]), "o_orderkey", 4000, "x")


@query("every_seventh", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) WHERE (k - 1) % 7 = 0")
def _(spark, sf):
    return rk.every_nth(fx.table(spark, sf, "orders", ["o_orderkey"]), ["o_orderkey"], 7)


@query("even_thinning", S + f", d AS (SELECT DISTINCT epoch, scene FROM sc), k AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY scene) - 1 AS pos, greatest(1, CAST(floor(count(*) OVER (PARTITION BY epoch) / 6) AS BIGINT)) AS step FROM d) SELECT epoch, scene FROM k WHERE pos % step = 0 AND pos / step < 6")
def _(spark, sf):
    return rk.thin_evenly(fx.scenes(spark, sf), ["epoch"], "scene", 6)


def grad_sql(along: str, across: str) -> str:
    w = f'OVER (PARTITION BY "{across}" ORDER BY "{along}")'
    p = f'CASE WHEN lag("{along}") {w} = "{along}" - 1 THEN lag(elev) {w} END'
    q = f'CASE WHEN lead("{along}") {w} = "{along}" + 1 THEN lead(elev) {w} END'
    return f"(CASE WHEN ({p}) IS NOT NULL AND ({q}) IS NOT NULL THEN (({q}) - ({p})) / 2 WHEN ({q}) IS NOT NULL THEN ({q}) - elev WHEN ({p}) IS NOT NULL THEN elev - ({p}) END) / 30.0::DOUBLE"


@query("grid_gradient", G + f", g AS (SELECT \"row\", \"col\", {grad_sql('col', 'row')} AS gx, {grad_sql('row', 'col')} AS gy FROM grid) SELECT \"row\", \"col\", {r('degrees(atan(sqrt(gx * gx + gy * gy)))', 'slope_deg')}, {r('cos(atan2(-gx, gy))', 'northness_g')}, {r('sin(atan2(-gx, gy))', 'eastness_g')} FROM g")
def _(spark, sf):
    g = fx.pixel_grid(spark, sf).select("row", "col", "elev")
    return sp.terrain_gradient(g, "elev", 30.0).select("row", "col", "slope_deg", "northness_g", "eastness_g")


# ---------------- spatial units ----------------

COMP = """, d AS MATERIALIZED (SELECT "row" AS y, "col" AS x, "row" * 2147483648 + "col" AS id FROM grid WHERE disturbed),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM d a JOIN d b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
walk AS (SELECT id AS a, id AS lab FROM d UNION SELECT e.b, walk.lab FROM walk JOIN e ON e.a = walk.a WHERE walk.lab < e.b),
lb AS (SELECT a, min(lab) AS label FROM walk GROUP BY 1)"""


@query("connected_components", "WITH RECURSIVE " + fx.GRID_SQL + COMP + f""" SELECT label, {n('count(*)', 'n_px')}, {n('min(y)', 'r0')}, {n('min(x)', 'c0')}, {n('max(y) + 1', 'r1')}, {n('max(x) + 1', 'c1')}, {r('avg(y)', 'row_mean')}, {r('avg(x)', 'col_mean')} FROM lb JOIN d ON d.id = lb.a GROUP BY 1 HAVING count(*) >= 10""")
def _(spark, sf):
    px = fx.pixel_grid(spark, sf).where("disturbed").select("row", "col")
    return sp.component_summary(sp.connected_components(px, 10))


@query("unit_profile", G + f", {GU} SELECT unit, {n('count(*)', 'n_px')}, {r('avg(elev)', 'elev_mean')}, {r('avg(slope)', 'slope_mean')} FROM gu GROUP BY 1")
def _(spark, sf):
    g = fx.pixel_grid(spark, sf)
    # units carry pixel lists; explode them back to cells before meeting the layers
    lists = grid_units(spark, sf).groupBy("unit").agg(F.collect_list(F.struct("row", "col")).alias("px"))  # a block is 4 x 5 cells
    cells = lists.select("unit", F.inline("px"))
    return sp.unit_profile(cells, g.select("row", "col", "elev", "slope"), "unit", ["elev", "slope"])


@query("block_average", G + f"SELECT {n('floor(\"row\" / 3)', 'row')}, {n('floor(\"col\" / 3)', 'col')}, {r('avg(lst)', 'lst')}, {n('count(*)', 'n')} FROM grid GROUP BY 1, 2")
def _(spark, sf):
    return sp.block_average(fx.pixel_grid(spark, sf), "lst", 3)


@query("upsample", G + f", i AS (SELECT unnest([0, 1, 2]) AS i) SELECT \"row\" * 3 + a.i AS \"row\", \"col\" * 3 + b.i AS \"col\", {r('lst', 'lst', 9)} FROM grid, i a, i b", 9)
def _(spark, sf):
    return sp.upsample(fx.pixel_grid(spark, sf).select("row", "col", "lst"), 3)


@query("domain_mask", G + ", a AS (SELECT \"row\", \"col\" FROM grid WHERE slope < 20 AND elev BETWEEN 900 AND 1500) SELECT * FROM a EXCEPT SELECT \"row\", \"col\" FROM grid WHERE disturbed")
def _(spark, sf):
    g = fx.pixel_grid(spark, sf)
    flat = g.where((F.col("slope") < 20) & F.col("elev").between(900, 1500)).select("row", "col")
    return flat.join(g.where("disturbed").select("row", "col"), ["row", "col"], "left_anti")
