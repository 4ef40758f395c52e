"""Queries for grouped summaries and composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from regrowth.functions import columns as fc
from regrowth.operators import aggregate as ag
from regrowth.operators import binning as bn
from regrowth.operators import quantiles as qt
from regrowth.operators import sketches as sk
from regrowth.operators import ranking as rk
from regrowth.operators import spatial as sp
from regrowth.plans import fixtures as fx
from regrowth.plans.registry import n, query, r
from regrowth.session import materialise

U, L = f"WITH {fx.UNIT_SQL}\n", f"WITH {fx.LONG_SQL}\n"
P, S, G = f"WITH {fx.PIXEL_SQL}\n", f"WITH {fx.SCENE_SQL}\n", f"WITH {fx.GRID_SQL}\n"
SE = "stddev_samp({0}) / sqrt(count({0}))"


@query("binned_mean_se", L + f"SELECT src, {n('bin', 'bin')}, {n('count(dndvi)', 'n')}, {r('avg(dndvi)', 'mean')}, {r(SE.format('dndvi'), 'se')} FROM post GROUP BY src, bin HAVING count(dndvi) >= 10")
def _(spark, sf):
    return ag.mean_se(fx.post_panel(spark, sf).withColumn("bin", bn.age_bin()), ["src", "bin"], "dndvi", 10)


@query("group_mean_se", L + f"SELECT agent, {n('count(*)', 'n')}, {r('avg(dlst)', 'mean')}, {r(SE.format('dlst'), 'se')} FROM post WHERE agent IS NOT NULL AND agent <> '' AND age < 4 AND dq IN ('canonical', 'mmdd') GROUP BY agent HAVING count(*) >= 8")
def _(spark, sf):
    p = fx.post_panel(spark, sf).where((F.col("age") < 4.0) & F.col("dq").isin("canonical", "mmdd"))
    return ag.mean_se(ag.named_groups(p, "agent"), ["agent"], "dlst", 8)


@query("count_by", U + f"SELECT src, year, {n('count(*)', 'n')} FROM unit GROUP BY ALL")
def _(spark, sf):
    return fx.units(spark, sf).groupBy("src", "year").agg(F.count(F.lit(1)).alias("n"))


@query("count_distinct", L + f"SELECT agent, {n('count(DISTINCT pid)', 'n_units')}, {n('count(DISTINCT epoch)', 'n_epochs')} FROM post GROUP BY 1")
def _(spark, sf):
    return fx.post_panel(spark, sf).groupBy("agent").agg(F.count_distinct("pid").alias("n_units"), F.count_distinct("epoch").alias("n_epochs"))


@query("count_distinct_sketch", L + f"SELECT agent, {n('count(DISTINCT pid)', 'n_units')}, true AS within_error FROM post GROUP BY 1")
def _(spark, sf):
    """Units by agent from sketches kept by period and then merged, held against the exact count."""
    rows = fx.post_panel(spark, sf)
    parts = materialise(sk.distinct_parts(rows, ["agent", "epoch"], "pid"), "distinct-sketches")
    exact = rows.groupBy("agent").agg(F.count_distinct("pid").alias("n_units"))
    both = exact.join(sk.merged_distinct(parts, ["agent"], "_about").withColumnRenamed("agent", "_a"), F.col("agent").eqNullSafe(F.col("_a")))
    return both.select("agent", "n_units", (F.abs(F.col("_about") - F.col("n_units")) <= F.greatest(F.lit(1.0), F.col("n_units") * sk.distinct_error())).alias("within_error"))


@query("dedup_composite", L + "SELECT DISTINCT event, year, area_ha, n_px FROM post")
def _(spark, sf):
    return fx.post_panel(spark, sf).dropDuplicates(["event", "year", "area_ha", "n_px"]).select("event", "year", "area_ha", "n_px")


QS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


@query("quantiles", L + f", e AS (SELECT src, pid, min(elev) AS elev FROM lp WHERE NOT is_pre AND clean GROUP BY 1, 2) SELECT src, {n('count(*)', 'n')}, " + ", ".join(r(f"quantile_cont(elev, {q}::DOUBLE)", f"q{int(q * 100):02d}") for q in QS) + " FROM e GROUP BY 1")
def _(spark, sf):
    lp = fx.long_panel(spark, sf).where(~F.col("is_pre") & F.col("clean"))
    units = lp.groupBy("src", "pid").agg(F.min("elev").alias("elev"))
    return qt.exact_quantiles(units, ["src"], "elev", QS, [f"q{int(q * 100):02d}" for q in QS], count="n")


@query(
    "quantiles_sketch",
    L + f", e AS (SELECT epoch, src, dlst FROM lp WHERE NOT is_pre AND clean), q AS (SELECT unnest({QS[1:-1]}::DOUBLE[]) AS q) SELECT src, {r('q', 'q')}, {n('count(*)', 'n')}, true AS within_error FROM e, q GROUP BY src, q",
)
def _(spark, sf):
    """Quantiles of the anomaly from sketches kept by period and merged; their exact ranks are held against the wanted ones."""
    rows = fx.long_panel(spark, sf).where(~F.col("is_pre") & F.col("clean")).select("epoch", "src", "dlst")
    parts = materialise(sk.quantile_parts(rows, ["src", "epoch"], "dlst"), "quantile-sketches")
    names = [f"q{i}" for i in range(len(QS) - 2)]
    got = sk.merged_quantiles(parts, ["src"], QS[1:-1], names).drop("sketch")
    ranked = rows.join(got, "src").groupBy("src").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.struct((F.avg((F.col("dlst") < F.col(x)).cast("double"))).alias("lo"), (F.avg((F.col("dlst") <= F.col(x)).cast("double"))).alias("hi")).alias(x) for x in names],
    )
    off = lambda x, q: F.greatest(F.col(f"{x}.lo") - q, q - F.col(f"{x}.hi"), F.lit(0.0))
    each = F.array(*[F.struct(F.lit(q).alias("q"), (off(x, q) <= sk.rank_error()).alias("within_error")) for x, q in zip(names, QS[1:-1])])
    return ranked.select("src", "n", F.inline(each))


@query("median_iqr", P + f"SELECT {n('floor((chm - 8) / 2)', 'bin')}, {n('count(*)', 'n')}, {r('median(lst)', 'med', 9)}, {r('quantile_cont(lst, 0.25)', 'q25', 9)}, {r('quantile_cont(lst, 0.75)', 'q75', 9)} FROM px WHERE chm >= 8 AND chm < 50 GROUP BY 1 HAVING count(*) >= 50", 9)
def _(spark, sf):
    px = fx.pixel_sample(spark, sf).where((F.col("chm") >= 8) & (F.col("chm") < 50)).withColumn("bin", bn.age_bin("chm", 8.0, 2.0))
    return qt.exact_quantiles(px, ["bin"], "lst", [0.25, 0.5, 0.75], ["q25", "med", "q75"], min_n=50, count="n")


@query(
    "event_groups",
    U + f"SELECT event, agent, year, {n('count(*)', 'n')}, {r('sum(area_ha)', 'area_ha')}, {r('median(elev)', 'elev_med')} FROM unit WHERE src = 'event' AND event IS NOT NULL AND agent IS NOT NULL GROUP BY event, agent, year "
    f"UNION ALL SELECT NULL, NULL, NULL, {n('count(*)', 'n')}, {r('sum(area_ha)', 'area_ha')}, NULL FROM unit WHERE src = 'event'",
)
def _(spark, sf):
    u = fx.units(spark, sf).where(F.col("src") == "event")
    named = u.where(F.col("event").isNotNull() & F.col("agent").isNotNull())
    keys = ["event", "agent", "year"]
    sums = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("area_ha").alias("area_ha"))
    groups = sums.join(qt.small_quantiles(named, keys, "elev", [0.5], ["elev_med"]), keys)
    total = u.agg(F.count(F.lit(1)).alias("n"), F.sum("area_ha").alias("area_ha"))
    return groups.unionByName(total, allowMissingColumns=True).orderBy(F.desc("n"), "event", "year", "agent")


@query("total_plus_groups", U + f"SELECT CASE WHEN grouping(agent) = 0 THEN 'agent' WHEN grouping(era) = 0 THEN 'era' ELSE 'all' END AS grouping, CASE WHEN grouping(agent) = 0 THEN agent WHEN grouping(era) = 0 THEN era ELSE 'all' END AS level, {n('count(*)', 'n')}, {r('avg(elev)', 'elev')} FROM unit GROUP BY GROUPING SETS ((), (agent), (era))")
def _(spark, sf):
    return ag.with_total(fx.units(spark, sf), ["agent", "era"], [F.count(F.lit(1)).alias("n"), F.avg("elev").alias("elev")])


@query("share_of_total", U + f"SELECT CASE WHEN elev < 1000 THEN 'lt1000' WHEN elev < 2000 THEN '1000_2000' ELSE 'gt2000' END AS band, {n('count(*)', 'n')}, {r('sum(area_ha) / sum(sum(area_ha)) OVER ()', 'share_area')}, {r('100.0 * count(*) / sum(count(*)) OVER ()', 'share_n')} FROM unit WHERE src = 'event' GROUP BY 1")
def _(spark, sf):
    u = fx.units(spark, sf).where(F.col("src") == "event")
    band = bn.band_of("elev", [("lt1000", -1e9, 1000), ("1000_2000", 1000, 2000), ("gt2000", 2000, 1e9)])
    g = u.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("area_ha").alias("area"))
    return ag.add_share(ag.add_share(g, "area", "share_area"), "n", "share_n", percent=True).drop("area")


TOP = """SELECT agent, event, n, area FROM (SELECT agent, event, count(*) AS n, sum(area_ha) AS area,
  row_number() OVER (PARTITION BY agent ORDER BY sum(area_ha) DESC, event) AS k FROM unit
  WHERE src = 'event' AND event IS NOT NULL AND NOT contains(event, '、') AND agent IN ('typhoon_rain', 'rainfall', 'earthquake') GROUP BY 1, 2) WHERE k = 1"""


@query("argmax_group", U + f"SELECT agent, event, {n('n', 'n')}, {r('area', 'area')} FROM ({TOP})")
def _(spark, sf):
    u = fx.units(spark, sf).where((F.col("src") == "event") & F.col("agent").isin("typhoon_rain", "rainfall", "earthquake"))
    single = u.where(F.col("event").isNotNull() & ~fc.contains_or_false("event", fc.LIST_MARK))
    g = single.groupBy("agent", "event").agg(F.count(F.lit(1)).alias("n"), F.sum("area_ha").alias("area"))
    best = g.groupBy("agent").agg(F.min_by(F.struct("event", "n", "area"), F.struct(-F.col("area"), F.col("event"))).alias("t"))
    return best.select("agent", "t.*")


@query("first_per_group", L + f"SELECT pid, {r('arg_min(dndvi, yr) FILTER (dndvi IS NOT NULL)', 'first_dndvi')}, {n('min(yr) FILTER (dndvi IS NOT NULL)', 'first_year')} FROM lp GROUP BY pid HAVING count(dndvi) > 0")
def _(spark, sf):
    lp = fx.long_panel(spark, sf).where(F.col("dndvi").isNotNull())
    return lp.groupBy("pid").agg(F.min_by("dndvi", "yr").alias("first_dndvi"), F.min("yr").alias("first_year"))


@query("collect_distinct", U + "SELECT agent, array_to_string(list_sort(list(DISTINCT dq)), ',') AS dqs, array_to_string(list_sort(list(DISTINCT year)), ',') AS years FROM unit GROUP BY agent")
def _(spark, sf):
    # distinct first: the collected sets are the few date qualities and event years
    g = fx.units(spark, sf).groupBy("agent").agg(F.sort_array(F.collect_set("dq")).alias("dqs"), F.sort_array(F.collect_set("year")).alias("years"))
    return g.select("agent", F.array_join("dqs", ",").alias("dqs"), F.array_join(F.col("years").cast("array<string>"), ",").alias("years"))


@query("weighted_counts", U + f"SELECT CASE WHEN grouping(dq) = 0 THEN 'dq' WHEN grouping(agent) = 0 THEN 'agent' WHEN grouping(era) = 0 THEN 'era' ELSE 'all' END AS grouping, CASE WHEN grouping(dq) = 0 THEN dq WHEN grouping(agent) = 0 THEN agent WHEN grouping(era) = 0 THEN era ELSE 'all' END AS level, {n('sum(n)', 'total')} FROM (SELECT year, event, dq, agent, era, count(*) AS n FROM unit GROUP BY ALL) GROUP BY GROUPING SETS ((), (dq), (agent), (era))")
def _(spark, sf):
    dim = fx.units(spark, sf).groupBy("year", "event", "dq", "agent", "era").agg(F.count(F.lit(1)).alias("n"))
    return ag.with_total(dim, ["dq", "agent", "era"], [F.sum("n").alias("total")])


@query("conditional_counts", U + f"SELECT src, {n('count_if(area_ha >= 10)', 'n_ge10')}, {n('count_if(redist_frac < 0.05)', 'n_ok')}, {n('count(*)', 'n')} FROM unit GROUP BY src")
def _(spark, sf):
    return fx.units(spark, sf).groupBy("src").agg(F.count_if(F.col("area_ha") >= 10).alias("n_ge10"), F.count_if(F.col("redist_frac") < 0.05).alias("n_ok"), F.count(F.lit(1)).alias("n"))


def sensor_values(spark, sf):
    """Mean value of a unit as one sensor sees it in one period, with a size."""
    li = fx.table(spark, sf, "lineitem", ["l_partkey", "l_returnflag", "l_shipdate", "l_extendedprice"])
    df = li.select(F.col("l_partkey").alias("pid"), F.col("l_returnflag").alias("sensor"), F.year("l_shipdate").cast("long").alias("period"), (F.col("l_extendedprice") / 1e4).alias("x"))
    return df.groupBy("pid", "sensor", "period").agg(F.avg("x").alias("value")).withColumn("area_ha", F.lit(0.5) + (F.col("pid") % 40) * 0.5)


SENSOR_SQL = "sv AS (SELECT l_partkey AS pid, l_returnflag AS sensor, CAST(year(l_shipdate) AS BIGINT) AS period, avg(l_extendedprice / 1e4) AS value, 0.5::DOUBLE + (l_partkey % 40) * 0.5::DOUBLE AS area_ha FROM lineitem GROUP BY ALL)"
PAIR_SQL = "pr AS (SELECT a.pid, a.period, a.area_ha, a.value AS y, b.value AS x FROM sv a JOIN sv b USING (pid, period) WHERE a.sensor = 'A' AND b.sensor = 'R')"


def sensor_pairs(spark, sf, a="A", b="R"):
    """Both sensors of a unit in one period side by side, from one grouped pass instead of a self-join."""
    v = sensor_values(spark, sf).where(F.col("sensor").isin(a, b))
    pick = lambda s: F.max(F.when(F.col("sensor") == s, F.col("value")))
    g = v.groupBy("pid", "period", "area_ha").agg(pick(a).alias("y"), pick(b).alias("x"))
    return g.where(F.col("y").isNotNull() & F.col("x").isNotNull())


@query("bias_rmse_corr", f"WITH {SENSOR_SQL}, {PAIR_SQL} SELECT period, {n('count(*)', 'n')}, {r('avg(y - x)', 'bias')}, {r('sqrt(avg((y - x) * (y - x)))', 'rmse')}, {r('corr(y, x)', 'r')} FROM pr GROUP BY 1")
def _(spark, sf):
    return ag.paired_errors(sensor_pairs(spark, sf), ["period"], "x", "y")


REG = f"{n('count(*)', 'n')}, {r('regr_slope(y, x)', 'slope')}, {r('regr_intercept(y, x)', 'intercept')}, {r('corr(y, x)', 'r')}, {r('avg(y - x)', 'bias')}, {r('stddev_pop(y - x)', 'sd_diff')}, {r('avg(x)', 'mean_ref')}"


@query("simple_regression", f"WITH {SENSOR_SQL}, {PAIR_SQL} SELECT {REG} FROM pr HAVING count(*) >= 30")
def _(spark, sf):
    return ag.simple_regression(sensor_pairs(spark, sf), [], "x", "y", 30)


@query("ivw_pool", P + f", s AS (SELECT floor(elev / 250) AS slice, avg(lst) AS v, stddev_samp(lst) / sqrt(count(*)) AS se FROM px GROUP BY 1), p AS (SELECT count(*) AS n, sum(v / (se * se)) / sum(1 / (se * se)) AS pooled, sqrt(1 / sum(1 / (se * se))) AS pooled_se FROM s) SELECT {n('any_value(n)', 'n')}, {r('any_value(pooled)', 'pooled')}, {r('any_value(pooled_se)', 'pooled_se')}, {r('sum((v - pooled) * (v - pooled) / (se * se))', 'q')}, {n('any_value(n) - 1', 'df')} FROM s, p")
def _(spark, sf):
    g = ag.mean_se(fx.pixel_sample(spark, sf).withColumn("slice", bn.height_slice()), ["slice"], "lst")
    return ag.pooled_by_variance(g, [], "mean", "se")


@query("annual_mean_gated", L + f"SELECT event, yr, {n('count(dlst)', 'n')}, {r('avg(dlst)', 'dlst')}, {r('avg(dndvi)', 'dndvi')} FROM lp WHERE event IS NOT NULL GROUP BY 1, 2 HAVING count(dlst) >= 2")
def _(spark, sf):
    lp = fx.long_panel(spark, sf).where(F.col("event").isNotNull())
    return lp.groupBy("event", "yr").agg(F.count("dlst").alias("n"), F.avg("dlst").alias("dlst"), F.avg("dndvi").alias("dndvi")).where(F.col("n") >= 2)


@query("min_max_ranges", L + f", c AS (SELECT year, count(*) AS n, avg(dlst) AS m FROM post GROUP BY 1 HAVING count(*) >= 50) SELECT {n('count(*)', 'n_cohorts')}, {r('min(m)', 'lo')}, {r('max(m)', 'hi')}, array_to_string(list(year ORDER BY year), ',') AS cohorts FROM c")
def _(spark, sf):
    c = fx.post_panel(spark, sf).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.avg("dlst").alias("m")).where(F.col("n") >= 50)
    return c.agg(F.count(F.lit(1)).alias("n_cohorts"), F.min("m").alias("lo"), F.max("m").alias("hi"), F.array_join(F.sort_array(F.collect_list("year")).cast("array<string>"), ",").alias("cohorts"))


@query("severity_summary", L + f", s AS (SELECT pid, src, avg(dndvi) AS sev FROM post WHERE age >= 0.6 AND age < 3.0 GROUP BY 1, 2 HAVING avg(dndvi) IS NOT NULL) SELECT src, {n('count(*)', 'n')}, {r('quantile_cont(sev, 0.25)', 'q25')}, {r('median(sev)', 'med')}, {r('quantile_cont(sev, 0.75)', 'q75')} FROM s GROUP BY 1")
def _(spark, sf):
    p = fx.post_panel(spark, sf).where((F.col("age") >= 0.6) & (F.col("age") < 3.0))
    sev = p.groupBy("pid", "src").agg(F.avg("dndvi").alias("sev"))
    return qt.exact_quantiles(sev, ["src"], "sev", [0.25, 0.5, 0.75], ["q25", "med", "q75"], count="n")


@query("cohort_reach", L + f", b AS (SELECT year, bin, count(*) AS n, count(DISTINCT pid) AS u, max(age) AS a FROM post GROUP BY 1, 2) SELECT year, {n('sum(n)', 'n_rows')}, {r('max(a)', 'max_age')}, {n('coalesce(max(bin) FILTER (n >= 12), -1)', 'max_bin')}, {n('any_value(nu)', 'n_units')} FROM b JOIN (SELECT year, count(DISTINCT pid) AS nu FROM post GROUP BY 1) USING (year) GROUP BY year")
def _(spark, sf):
    p = fx.post_panel(spark, sf).withColumn("bin", bn.age_bin())
    b = p.groupBy("year", "bin").agg(F.count(F.lit(1)).alias("n"), F.max("age").alias("a"))
    reach = b.groupBy("year").agg(F.sum("n").alias("n_rows"), F.max("a").alias("max_age"), F.coalesce(F.max(F.when(F.col("n") >= 12, F.col("bin"))), F.lit(-1)).alias("max_bin"))
    return reach.join(p.groupBy("year").agg(F.count_distinct("pid").alias("n_units")), "year")


@query("coverage_count", f"WITH {fx.WIDE_SQL} " + " UNION ALL ".join(f"SELECT '{v}_{p}' AS column_name, {n(f'count({v}_{p})', 'n')} FROM wide" for p in fx.PERIODS for v in ("dlst", "dndvi")))
def _(spark, sf):
    return ag.non_null_counts(fx.wide_panel(spark, sf), [f"{v}_{p}" for p in fx.PERIODS for v in ("dlst", "dndvi")])


@query("paired_series", L + f"SELECT {r('0.6::DOUBLE + bin + 0.5::DOUBLE', 'age')}, {n('count(*)', 'n')}, {r('avg(dlst)', 'dlst')}, {r(SE.format('dlst'), 'dlst_se')}, {r('avg(dndvi)', 'dndvi')}, {r(SE.format('dndvi'), 'dndvi_se')} FROM post WHERE dndvi IS NOT NULL AND dlst IS NOT NULL GROUP BY bin HAVING count(*) >= 30")
def _(spark, sf):
    p = fx.post_panel(spark, sf).where(F.col("dlst").isNotNull() & F.col("dndvi").isNotNull()).withColumn("bin", bn.age_bin())
    g = p.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("dlst").alias("dlst"), fc.standard_error("dlst").alias("dlst_se"), F.avg("dndvi").alias("dndvi"), fc.standard_error("dndvi").alias("dndvi_se"))
    return g.where(F.col("n") >= 30).withColumn("age", bn.bin_centre()).drop("bin")


@query("partial_merge", S + f"SELECT cell, epoch, {r('sum(value)', 'total', 4)}, {n('count(*)', 'cnt')} FROM clear GROUP BY ALL", 4)
def _(spark, sf):
    s = fx.scenes(spark, sf).where(fc.clear_sky("qa"))
    # accumulators as separate sensor files would carry them
    parts = [
        s.where(F.col("sensor") == x).groupBy("cell", "epoch").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("cnt"))
        for x in ("click", "view", "error")
    ] + [s.where(~F.col("sensor").isin("click", "view", "error")).groupBy("cell", "epoch").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("cnt"))]
    return ag.merge_partials(parts, ["cell", "epoch"], ["total", "cnt"])


@query("composite_mean", S + f"SELECT cell, epoch, {n('count(value)', 'n_clear')}, {r('CASE WHEN count(value) >= 3 THEN avg(value) END', 'mean', 8)} FROM clear GROUP BY ALL", 8)
def _(spark, sf):
    return ag.composite(fx.scenes(spark, sf).where(fc.clear_sky("qa")), ["cell", "epoch"], "value")


@query("composite_median", S + f"SELECT cell, epoch, {r('median(value)', 'median')} FROM clear GROUP BY ALL")
def _(spark, sf):
    # a cell has few observations in a period: one aggregate
    return qt.small_quantiles(fx.scenes(spark, sf).where(fc.clear_sky("qa")), ["cell", "epoch"], "value", [0.5], ["median"])


@query("per_sensor_composite", S + f"SELECT cell, epoch, sensor, {n('count(value)', 'n_clear')}, {r('CASE WHEN count(value) >= 3 THEN avg(value) END', 'mean', 8)} FROM clear GROUP BY ALL", 8)
def _(spark, sf):
    return ag.composite(fx.scenes(spark, sf).where(fc.clear_sky("qa")), ["cell", "epoch", "sensor"], "value")


@query("summary_stats", P + f"SELECT {n('floor(elev / 250)', 'slice')}, {n('count(*)', 'n')}, {r('avg(lst)', 'mean', 9)}, {r('stddev_samp(lst)', 'sd', 9)}, {r('min(lst)', 'lo', 9)}, {r('max(lst)', 'hi', 9)}, {r('quantile_cont(lst, 0.25)', 'q25', 9)}, {r('median(lst)', 'q50', 9)}, {r('quantile_cont(lst, 0.75)', 'q75', 9)} FROM px GROUP BY 1", 9)
def _(spark, sf):
    px = fx.pixel_sample(spark, sf).withColumn("slice", bn.height_slice())
    q = qt.exact_quantiles(px, ["slice"], "lst", [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    return ag.moments(px, ["slice"], "lst").join(q, "slice")


@query("scene_usage", S + f"SELECT epoch, {n('count(*)', 'n_scenes')}, {n('count_if(c >= 200)', 'n_used')} FROM (SELECT epoch, scene, count(*) FILTER (qa <> 0 AND (qa & 62) = 0) AS c FROM sc GROUP BY ALL) GROUP BY 1")
def _(spark, sf):
    scene = fx.scenes(spark, sf).groupBy("epoch", "scene").agg(F.count_if(fc.clear_sky("qa")).alias("c"))
    return scene.groupBy("epoch").agg(F.count(F.lit(1)).alias("n_scenes"), F.count_if(F.col("c") >= 200).alias("n_used"))


@query("unit_anomaly_index", S + f", own AS (SELECT cell, avg(value) AS m FROM clear GROUP BY 1 HAVING count(*) >= 10) SELECT epoch, {r('avg(value - m)', 'anomaly')}, {n('count(*)', 'n')} FROM clear JOIN own USING (cell) GROUP BY 1")
def _(spark, sf):
    return ag.unit_anomaly(fx.scenes(spark, sf).where(fc.clear_sky("qa")), "cell", "epoch", "value")


# ---------------- sort, limit, set operations ----------------


@query("sort_desc", U + f"SELECT event, {n('count(*)', 'n')} FROM unit WHERE event IS NOT NULL GROUP BY 1 ORDER BY n DESC, event")
def _(spark, sf):
    u = fx.units(spark, sf).where(F.col("event").isNotNull())
    return u.groupBy("event").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event")


@query("union_all", f"WITH {fx.WIDE_SQL} " + " UNION ALL ".join(f"SELECT pid, '{p}' AS epoch, {r(f'dlst_{p}', 'dlst')} FROM wide WHERE dlst_{p} IS NOT NULL" for p in fx.PERIODS))
def _(spark, sf):
    w = materialise(fx.wide_panel(spark, sf), "wide")  # read once per period
    return rk.union_all([w.where(F.col(f"dlst_{p}").isNotNull()).select("pid", F.lit(p).alias("epoch"), F.col(f"dlst_{p}").alias("dlst")) for p in fx.PERIODS])


@query("limit_head", f"SELECT o_orderkey, {r('o_totalprice', 'o_totalprice')} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6000")
def _(spark, sf):
    return fx.table(spark, sf, "orders", ["o_orderkey", "o_totalprice"]).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(6000)


@query("mask_jaccard", G + f", a AS (SELECT \"row\", \"col\" FROM grid WHERE disturbed), b AS (SELECT \"row\", \"col\" FROM grid WHERE lst > 25) SELECT {n('(SELECT count(*) FROM a)', 'n_a')}, {n('(SELECT count(*) FROM b)', 'n_b')}, {n('(SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b))', 'n_both')}, {n('(SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b))', 'n_either')}, {r('(SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) / (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b))', 'jaccard')}")
def _(spark, sf):
    g = fx.pixel_grid(spark, sf)
    return sp.mask_jaccard(g.where("disturbed"), g.where(F.col("lst") > 25))


@query("mask_difference", G + "SELECT \"row\", \"col\" FROM grid WHERE disturbed EXCEPT SELECT \"row\", \"col\" FROM grid WHERE lst > 27")
def _(spark, sf):
    g = fx.pixel_grid(spark, sf)
    return g.where("disturbed").select("row", "col").subtract(g.where(F.col("lst") > 27).select("row", "col"))


@query("mask_union", G + "SELECT \"row\", \"col\" FROM grid WHERE disturbed UNION SELECT \"row\", \"col\" FROM grid WHERE lst > 27")
def _(spark, sf):
    g = fx.pixel_grid(spark, sf)
    return g.where("disturbed").select("row", "col").union(g.where(F.col("lst") > 27).select("row", "col")).distinct()


@query("mask_intersect", G + "SELECT \"row\", \"col\" FROM grid WHERE disturbed INTERSECT SELECT \"row\", \"col\" FROM grid WHERE lst > 25")
def _(spark, sf):
    g = fx.pixel_grid(spark, sf)
    return g.where("disturbed").select("row", "col").intersect(g.where(F.col("lst") > 25).select("row", "col"))


@query("priority_mosaic", G + f"SELECT \"row\", \"col\", {r('coalesce(CASE WHEN slope > 15 THEN lst END, CASE WHEN elev < 1200 THEN elev END, slope)', 'value', 9)} FROM grid", 9)
def _(spark, sf):
    g = fx.pixel_grid(spark, sf)
    layers = [F.when(F.col("slope") > 15, F.col("lst")), F.when(F.col("elev") < 1200, F.col("elev")), F.col("slope")]
    return sp.first_valid([g.select("row", "col", v.alias("value")) for v in layers], "value")


LAST = "last AS (SELECT \"row\", \"col\", max(year) AS last_year FROM (SELECT \"row\", \"col\", yr AS year FROM grid WHERE disturbed UNION ALL SELECT \"row\", \"col\", 1990 + CAST(floor(slope) AS BIGINT) FROM grid WHERE slope > 8) GROUP BY 1, 2)"


def grid_last_year(spark, sf):
    g = fx.pixel_grid(spark, sf)
    events = g.where("disturbed").select("row", "col", F.col("yr").alias("year"))
    loss = g.where(F.col("slope") > 8).select("row", "col", (F.lit(1990) + F.floor("slope")).cast("long").alias("year"))
    return sp.last_event_year([events, loss])


def grid_units(spark, sf):
    """Disturbed cells with the id and event year of their 4 x 5 block."""
    g = fx.pixel_grid(spark, sf).where("disturbed")
    unit = F.floor(F.col("row") / 4) * 100 + F.floor(F.col("col") / 5)
    return g.withColumn("unit", unit.cast("long")).withColumn("year", F.lit(1995) + F.col("unit") % 6)


GU = "gu AS (SELECT *, CAST(floor(\"row\" / 4) * 100 + floor(\"col\" / 5) AS BIGINT) AS unit, 1995 + CAST(floor(\"row\" / 4) * 100 + floor(\"col\" / 5) AS BIGINT) % 6 AS year FROM grid WHERE disturbed)"


@query("last_event_year", G + f", {LAST} SELECT * FROM last")
def _(spark, sf):
    return grid_last_year(spark, sf)


@query("redisturb_fraction", G + f", {LAST}, {GU} SELECT unit, year, {r('avg(CASE WHEN last_year > year THEN 1.0 ELSE 0.0 END)', 'redist_frac')} FROM gu LEFT JOIN last USING (\"row\", \"col\") GROUP BY 1, 2")
def _(spark, sf):
    return sp.redisturbed_share(grid_units(spark, sf).select("unit", "year", "row", "col"), grid_last_year(spark, sf), "unit", "year")


@query("majority_value", G + f", {GU}, c AS (SELECT unit, yr, count(*) AS k FROM gu GROUP BY 1, 2) SELECT unit, {n('arg_min(yr, {{a: -k, b: yr}})'.replace('{{', '{').replace('}}', '}'), 'yr')}, {n('max(k)', 'n_votes')} FROM c GROUP BY 1")
def _(spark, sf):
    return sp.majority_code(grid_units(spark, sf), "unit", "yr")
