"""Queries for reading, writing, reshaping and deriving columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from regrowth.functions import columns as fc
from regrowth.operators import binning as bn
from regrowth.operators import reshape as rs
from regrowth.plans import fixtures as fx
from regrowth.plans.registry import n, query, r
from regrowth.session import new_work_path
from regrowth.sources import tables as tb

U, L, W = f"WITH {fx.UNIT_SQL}\n", f"WITH {fx.LONG_SQL}\n", f"WITH {fx.WIDE_SQL}\n"

# ---------------- sources and sinks ----------------


@query("scan_parquet", f"SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, {r('c_acctbal', 'c_acctbal')}, c_mktsegment FROM customer")
def _(spark, sf):
    return tb.scan_table(spark, f"{sf}/customer.parquet", clean_nan=True)


@query("scan_pruned", f"SELECT l_returnflag, {n('count(*)', 'n')}, {r('avg(l_quantity)', 'mean_qty')} FROM lineitem GROUP BY 1")
def _(spark, sf):
    df = fx.table(spark, sf, "lineitem", ["l_returnflag", "l_quantity"])
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean_qty"))


@query(
    "scan_json_dim",
    U + f"SELECT year || '/' || event AS code, event, year, coalesce(min(agent), '') AS agent, {n('count(*)', 'n')} FROM unit WHERE event IS NOT NULL GROUP BY event, year",
)
def _(spark, sf):
    u = fx.units(spark, sf).where(F.col("event").isNotNull())
    dim = u.groupBy("event", "year").agg(F.coalesce(F.min("agent"), F.lit("")).alias("agent"), F.count(F.lit(1)).alias("n"))
    code = F.concat_ws("/", F.col("year"), F.col("event"))
    path = new_work_path(spark, "dim")
    # one JSON object {code: fields} on a line, as the dimension files are laid out
    dim.select(F.to_json(F.create_map(code, F.struct("event", "year", "agent", "n"))).alias("value")).write.text(path)
    return tb.scan_json_dimension(spark, path, "event string, year bigint, agent string, n bigint")


SCENE_LIST = """SELECT epoch, scene AS id, count(*) FILTER (qa <> 0 AND (qa & 62) = 0) AS clear_px FROM sc GROUP BY 1, 2"""


@query("scan_json_array", f"WITH {fx.SCENE_SQL} SELECT epoch, id, clear_px >= 200 AS used, {n('clear_px', 'clear_px')} FROM ({SCENE_LIST})")
def _(spark, sf):
    return tb.scan_json_lists(spark, _scene_lists(spark, sf))


def _scene_lists(spark, sf) -> str:
    s = fx.scenes(spark, sf)
    counts = s.groupBy("epoch", F.col("scene").alias("id")).agg(F.count_if(fc.clear_sky("qa")).alias("clear_px"))
    item = F.struct("id", (F.col("clear_px") >= 200).alias("used"), "clear_px")
    lists = counts.groupBy("epoch").agg(F.to_json(F.collect_list(item)).alias("value"))  # a period has at most ten days
    path = new_work_path(spark, "scenes")
    lists.select(F.concat("epoch", F.lit("_items")).alias("name"), "value").repartition("name").write.partitionBy("name").text(path)
    return f"{path}/*"


@query(
    "scan_csv",
    f"""WITH {fx.GRID_SQL} SELECT CAST(floor("row" / 50) AS BIGINT) || '-' || CAST(floor("col" / 50) AS BIGINT) AS tile,
    {n('min("col")', 'west')}, {n('max("col") + 1', 'east')}, {n('min("row")', 'south')}, {n('max("row") + 1', 'north')} FROM grid GROUP BY 1""",
)
def _(spark, sf):
    path = new_work_path(spark, "tiles")
    _tiles(spark, sf).write.csv(path, header=True)
    return tb.scan_csv(spark, path, "tile string, west bigint, east bigint, south bigint, north bigint")


def _tiles(spark, sf):
    g = fx.pixel_grid(spark, sf)
    tile = F.concat_ws("-", F.floor(F.col("row") / 50), F.floor(F.col("col") / 50))
    return g.groupBy(tile.alias("tile")).agg(
        F.min("col").alias("west"), (F.max("col") + 1).alias("east"), F.min("row").alias("south"), (F.max("row") + 1).alias("north")
    )


@query("write_parquet", L + f"SELECT epoch, {n('count(*)', 'n')}, {r('sum(dlst)', 'total', 4)} FROM lp GROUP BY 1", 4)
def _(spark, sf):
    path = new_work_path(spark, "panel")
    tb.write_table(fx.long_panel(spark, sf), path, ["epoch"])
    return spark.read.parquet(path).groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), F.sum("dlst").alias("total"))


OLD_NEW = """, a AS (SELECT 'n_' || epoch AS key, count(*) AS value FROM lp GROUP BY 1),
b AS (SELECT 'n_' || epoch AS key, count(*) AS value FROM lp WHERE clean AND yr >= 1998 GROUP BY 1)"""


@query("merge_results", L + OLD_NEW + f" SELECT key, {n('value', 'value')} FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT key, {n('value', 'value')} FROM b")
def _(spark, sf):
    lp = fx.long_panel(spark, sf)
    key, count = F.concat(F.lit("n_"), F.col("epoch")).alias("key"), F.count(F.lit(1)).alias("value")
    return tb.merge_results(lp.groupBy(key).agg(count), lp.where(F.col("clean") & (F.col("yr") >= 1998)).groupBy(key).agg(count), ["key"])


@query(
    "replace_slices",
    L + f", s AS (SELECT epoch, pid, dlst FROM lp WHERE epoch <> 'c97' UNION ALL SELECT 'c97', pid, dlst * 2 FROM lp WHERE epoch = 'c98') SELECT epoch, {n('count(*)', 'n')}, {r('sum(dlst)', 'total', 4)} FROM s GROUP BY 1",
    4,
)
def _(spark, sf):
    lp = fx.long_panel(spark, sf).select("epoch", "pid", "dlst")
    fresh = lp.where(F.col("epoch") == "c98").select(F.lit("c97").alias("epoch"), "pid", (F.col("dlst") * 2).alias("dlst"))
    out = tb.replace_slices(lp, fresh, "epoch")
    return out.groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), F.sum("dlst").alias("total"))


@query(
    "replace_slices_in_place",
    L + f", s AS (SELECT epoch, pid, dlst FROM lp WHERE epoch <> 'c97' UNION ALL SELECT 'c97', pid, dlst * 2 FROM lp WHERE epoch = 'c98') SELECT epoch, {n('count(*)', 'n')}, {r('sum(dlst)', 'total', 4)} FROM s GROUP BY 1",
    4,
)
def _(spark, sf):
    """The same replacement behind the writer, done twice: only the named slice's folder changes."""
    path = new_work_path(spark, "sliced-panel")
    lp = fx.long_panel(spark, sf).select("epoch", "pid", "dlst")
    tb.write_table(lp, path, ["epoch"])
    stored = spark.read.parquet(path)
    fresh = stored.where(F.col("epoch") == "c98").select(F.lit("c97").alias("epoch"), "pid", (F.col("dlst") * 2).alias("dlst"))
    for _ in range(2):
        tb.replace_partitions(fresh, path, ["epoch"])
    return spark.read.parquet(path).groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), F.sum("dlst").alias("total"))


def _print_sql(name: str, cols: list[str]) -> str:
    text = "concat_ws('|', " + ", ".join(f"coalesce(length(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '~')" for x in cols) + ")"
    h = f"('0x' || substr(md5({text}), 1, 15))::BIGINT"
    return f"SELECT '{name}' AS table_name, {n('count(*)', 'n_rows')}, CAST(bit_xor({h}) AS BIGINT) AS checksum, CAST(sum({h}::HUGEINT) % 1152921504606846976 AS BIGINT) AS total FROM {name}"


PRINTED = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "epoch_us(o_orderdate)", "o_orderpriority"],
    "events": ["event_id", "epoch_us(ts)", "user_id", "event_type", "value", "props"],
}


@query("fingerprint", " UNION ALL ".join(_print_sql(k, v) for k, v in PRINTED.items()))
def _(spark, sf):
    return tb.union_evolving([tb.fingerprint(fx.table(spark, sf, k), k) for k in PRINTED])


@query(
    "schema_drift_guard",
    W + " UNION ALL ".join(f"SELECT '{p}' AS epoch, {n(f'count(dlst_{p})', 'n')} FROM wide" for p in fx.PERIODS),
)
def _(spark, sf):
    wide = fx.wide_panel(spark, sf)
    asked = [f"dlst_{p}" for p in ["c93", "c94", *fx.PERIODS, "c02"]]
    have = tb.present(wide, asked)
    one = wide.agg(*[F.count(x).alias(x) for x in have])
    return one.select(F.inline(F.array(*[F.struct(F.lit(x[5:]).alias("epoch"), F.col(x).alias("n")) for x in have])))


# ---------------- reshape, projection, derivation ----------------


@query("wide_to_long", L + f"SELECT pid, epoch, {r('age', 'age')}, {r('dlst', 'dlst')}, {r('dndvi', 'dndvi')}, is_pre FROM lp WHERE dlst IS NOT NULL")
def _(spark, sf):
    rows = rs.wide_to_long(fx.wide_panel(spark, sf), ["pid"], fx.PERIODS)
    return rows.select("pid", "epoch", "age", "dlst", "dndvi", "is_pre")


@query("epoch_age", L + f"SELECT pid, epoch, {r('yr + 0.62::DOUBLE', 'mid')}, {r('age', 'age')} FROM lp")
def _(spark, sf):
    lp = fx.long_panel(spark, sf).select("pid", "epoch", "t_event")
    dim = lp.select("epoch").distinct().withColumn("mid", bn.c(fc.period_year("epoch", 1900) + F.when(F.col("epoch") < "c50", 100).otherwise(0)) + F.lit(0.62))
    return lp.join(dim, "epoch").select("pid", "epoch", "mid", (F.col("mid") - F.col("t_event")).alias("age"))


@query("event_time_k", L + f"SELECT {n('round_even(age, 0)', 'k')}, {n('count(*)', 'n')} FROM lp GROUP BY 1")
def _(spark, sf):
    lp = fx.long_panel(spark, sf)
    k = fc.event_time(F.col("yr") + F.lit(0.62), "t_event")
    return lp.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("reference_lookup", L + f"SELECT pid, {r('dlst', 'reference')} FROM lp WHERE is_pre")
def _(spark, sf):
    return rs.reference_lookup(fx.long_panel(spark, sf), "pid", "dlst", F.col("is_pre"))


NET = ", ref AS (SELECT pid, dlst AS reference FROM lp WHERE is_pre), net AS (SELECT lp.*, reference, dlst - reference AS beta, CAST(round_even(age, 0) AS BIGINT) AS k FROM lp JOIN ref USING (pid))"


@query("net_of_reference", L + NET + f" SELECT pid, k, {r('beta', 'beta')} FROM net WHERE k <> -1")
def _(spark, sf):
    lp = fx.long_panel(spark, sf)
    ref = rs.reference_lookup(lp, "pid", "dlst", F.col("is_pre"))
    out = rs.net_of_reference(lp, ref, "pid", "dlst")
    return out.withColumn("k", fc.half_even("age")).where(F.col("k") != -1).select("pid", "k", "beta")


@query(
    "is_pre_flag",
    U + "SELECT pid, year, CASE WHEN year BETWEEN 1996 AND 2001 AND (year - 1) + 0.62::DOUBLE + 0.21::DOUBLE <= t_event THEN 'c' || lpad(((year - 1) % 100)::VARCHAR, 2, '0') ELSE '' END AS tag FROM unit",
)
def _(spark, sf):
    return fx.units(spark, sf).select("pid", "year", fc.pre_tag("year", "t_event", 1996, 2001).alias("tag"))


@query("straddle_drop", L + f"SELECT epoch, {n('count(*)', 'n')} FROM lp WHERE is_pre OR NOT (age > -0.30 AND age < 0.7) GROUP BY 1")
def _(spark, sf):
    return fx.long_panel(spark, sf).where(~fc.straddles()).groupBy("epoch").agg(F.count(F.lit(1)).alias("n"))


@query("quality_flag", U + "SELECT pid, clean FROM unit")
def _(spark, sf):
    return fx.units(spark, sf).select("pid", fc.clean_flag().alias("clean"))


@query("post_filter", L + f"SELECT pid, epoch, {r('age', 'age')}, {r('dlst', 'dlst')} FROM post")
def _(spark, sf):
    return fx.post_panel(spark, sf).select("pid", "epoch", "age", "dlst")


@query("class_relabel", L + f"SELECT CASE WHEN src = 'event' THEN 'landslide' ELSE 'annual_loss' END AS cls, {n('count(*)', 'n')}, {n('count(DISTINCT pid)', 'n_units')} FROM post GROUP BY 1")
def _(spark, sf):
    cls = F.when(F.col("src") == "event", "landslide").otherwise("annual_loss")
    return fx.post_panel(spark, sf).groupBy(cls.alias("cls")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pid").alias("n_units"))


@query(
    "surrogate_key",
    U + f"SELECT pid, {n('dense_rank() OVER (ORDER BY event, year, elev, area_ha)', 'gid')} FROM unit WHERE event IS NOT NULL",
)
def _(spark, sf):
    return rs.surrogate_key(fx.units(spark, sf), ["event", "year", "elev", "area_ha"]).select("pid", "gid")


@query("code_assign", U + f"SELECT year, event AS name, {n('row_number() OVER (ORDER BY year, event NULLS FIRST)', 'code')}, {n('count(*)', 'n')} FROM unit GROUP BY year, event")
def _(spark, sf):
    u = fx.units(spark, sf).withColumn("name", F.col("event"))
    return rs.code_dimension(u, "year", "name").select("year", "name", "code", "n")


@query("decimal_year", f"SELECT o_orderkey, {r('t', 't')}, CAST(make_date(CAST(floor(t) AS BIGINT), 1, 1) + CAST(round_even((t - floor(t)) * 365.25::DOUBLE, 0) AS INTEGER) AS VARCHAR) AS back FROM (SELECT o_orderkey, year(o_orderdate) + (dayofyear(o_orderdate) - 0.5::DOUBLE) / 365.25::DOUBLE AS t FROM orders)")
def _(spark, sf):
    o = fx.table(spark, sf, "orders", ["o_orderkey", "o_orderdate"]).withColumn("t", fc.decimal_year("o_orderdate"))
    return o.select("o_orderkey", "t", fc.date_of_decimal_year("t").cast("string").alias("back"))


def _catalogue(spark, sf):
    """Units with image dates written in three layouts, some of them unreadable."""
    u = fx.units(spark, sf).select("pid", "year", "event")
    b = F.date_add(F.make_date(F.col("year").cast("int"), F.lit(3), F.lit(1)), (F.col("pid") % 60).cast("int"))
    a = F.date_add(b, (30 + F.col("pid") % 90).cast("int"))
    fmt = lambda d: (
        F.when(F.col("pid") % 37 == 0, "n/a").when(F.col("pid") % 3 == 0, F.date_format(d, "yyyyMMdd"))
        .when(F.col("pid") % 3 == 1, F.date_format(d, "yyyy/MM/dd")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    )
    return u.withColumns({"before_date": fmt(b), "after_date": fmt(a)})


CAT_SQL = """, cat0 AS (SELECT pid, year, event, make_date(year, 3, 1) + CAST(pid % 60 AS INTEGER) AS b FROM unit),
cat AS (SELECT pid, year, event, CASE WHEN pid % 37 <> 0 THEN b END AS b, CASE WHEN pid % 37 <> 0 THEN b + CAST(30 + pid % 90 AS INTEGER) END AS a FROM cat0)"""


@query("multi_format_date", U + CAT_SQL + " SELECT pid, CAST(b AS VARCHAR) AS before_day, CAST(a AS VARCHAR) AS after_day FROM cat")
def _(spark, sf):
    df = _catalogue(spark, sf)
    return df.select("pid", fc.parse_date("before_date").cast("string").alias("before_day"), fc.parse_date("after_date").cast("string").alias("after_day"))


def _known_dates(spark, sf):
    """Known dates: the first day of August for each storm name that holds no MMDD, one per year."""
    u = fx.units(spark, sf).where(F.col("event").rlike("^颱風[AB]$"))
    return u.select("year", F.col("event").alias("name")).distinct().withColumn("date", F.make_date(F.col("year").cast("int"), F.lit(8), F.lit(1)))


@query(
    "event_date_resolve",
    U + CAT_SQL + f""", d0 AS (SELECT *, CASE WHEN regexp_full_match(event, '颱風[AB]') THEN make_date(year, 8, 1) END AS known,
      CASE WHEN regexp_matches(event, '^[0-9]{{4}}') AND NOT contains(event, '、') AND NOT contains(event, '暨') THEN TRY_CAST(year || '-' || substr(event, 1, 2) || '-' || substr(event, 3, 2) AS DATE) END AS mm FROM cat),
    d1 AS (SELECT *, coalesce(known, mm) AS first FROM d0),
    d2 AS (SELECT *, CASE WHEN b IS NULL OR a IS NULL OR first BETWEEN b - 45 AND a + 45 THEN first END AS kept FROM d1),
    d3 AS (SELECT *, coalesce(kept, b + CAST(floor((a - b) / 2) AS INTEGER), make_date(year, 7, 15)) AS d,
      CASE WHEN kept IS NOT NULL AND known IS NOT NULL THEN 'canonical' WHEN kept IS NOT NULL THEN 'mmdd' WHEN b IS NOT NULL THEN 'midpoint' ELSE 'yearmid' END AS dq FROM d2)
    SELECT pid, CAST(d AS VARCHAR) AS event_date, dq, {n('coalesce(a - b, -1)', 'bracket_days')}, {r('year(d) + (dayofyear(d) - 0.5::DOUBLE) / 365.25::DOUBLE', 't_event')} FROM d3""",
)
def _(spark, sf):
    out = rs.resolve_event_date(_catalogue(spark, sf), _known_dates(spark, sf), "year", "event", "before_date", "after_date")
    return out.select("pid", F.col("event_date").cast("string").alias("event_date"), "dq", "bracket_days", "t_event")


@query(
    "agent_from_text",
    U + f"SELECT CASE WHEN contains(e, '地震') THEN 'earthquake' WHEN contains(e, '颱風') THEN 'typhoon_rain' WHEN contains(e, '豪雨') OR contains(e, '熱帶低壓') THEN 'rainfall' WHEN contains(e, '堰塞湖') THEN 'other' ELSE 'unknown' END AS found, {n('count(*)', 'n')} FROM (SELECT coalesce(event, '') AS e FROM unit) GROUP BY 1",
)
def _(spark, sf):
    return fx.units(spark, sf).groupBy(fc.trigger_of("event").alias("found")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "dimension_repair",
    U + f", dim AS (SELECT year, event, coalesce(min(agent), '') AS agent, count(*) AS n FROM unit WHERE event IS NOT NULL GROUP BY 1, 2) SELECT year || '/' || event AS code, CASE WHEN year = 1994 THEN 'repaired ' || event ELSE event END AS event, CASE WHEN year = 1994 THEN 'typhoon_rain' ELSE agent END AS agent, {n('n', 'n')} FROM dim",
)
def _(spark, sf):
    u = fx.units(spark, sf).where(F.col("event").isNotNull())
    dim = u.groupBy("year", "event").agg(F.coalesce(F.min("agent"), F.lit("")).alias("agent"), F.count(F.lit(1)).alias("n"))
    dim = dim.withColumn("code", F.concat_ws("/", "year", "event"))
    fixes = dim.where(F.col("year") == 1994).select("code", F.concat(F.lit("repaired "), F.col("event")).alias("event"), F.lit("typhoon_rain").alias("agent"))
    return rs.repair_dimension(dim, fixes, "code", ["event", "agent"]).select("code", "event", "agent", "n")


@query("anomaly_pair", L + f"SELECT pid, epoch, {r('sqrt(v) - sqrt(ctl)', 'gap')} FROM lp")
def _(spark, sf):
    return fx.long_panel(spark, sf).select("pid", "epoch", (F.sqrt("v") - F.sqrt("ctl")).alias("gap"))


@query("db_difference", L + f"SELECT pid, epoch, {r('10 * log10(v) - 10 * log10(ctl)', 'gap_db')} FROM lp")
def _(spark, sf):
    return fx.long_panel(spark, sf).select("pid", "epoch", fc.db_gap("v", "ctl").alias("gap_db"))


NDVI = "CASE WHEN abs((nir * 2.75e-5 - 0.2) + (red * 2.75e-5 - 0.2)) > 1e-6 THEN ((nir * 2.75e-5 - 0.2) - (red * 2.75e-5 - 0.2)) / ((nir * 2.75e-5 - 0.2) + (red * 2.75e-5 - 0.2)) END"


@query("radiance_scale", f"WITH {fx.SCENE_SQL} SELECT event_id, {r('st * 0.00341802::DOUBLE + 149 - 273.15::DOUBLE', 'lst')}, {r(NDVI, 'ndvi')} FROM sc")
def _(spark, sf):
    return fx.scenes(spark, sf).select("event_id", fc.surface_celsius("st").alias("lst"), fc.greenness("red", "nir").alias("ndvi"))


@query("qa_bitmask", f"WITH {fx.SCENE_SQL} SELECT cell, {n('count(*)', 'n_clear')} FROM clear GROUP BY 1")
def _(spark, sf):
    return fx.scenes(spark, sf).where(fc.clear_sky("qa")).groupBy("cell").agg(F.count(F.lit(1)).alias("n_clear"))


@query(
    "scene_filter",
    f"WITH {fx.SCENE_SQL} SELECT scene, {n('count(*)', 'n_clear')} FROM clear WHERE sensor IN ('click', 'view', 'error') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-28' GROUP BY 1 HAVING count(*) >= 110",
)
def _(spark, sf):
    s = fx.scenes(spark, sf)
    season = s.where(F.col("sensor").isin("click", "view", "error") & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-28").cast("timestamp")))
    clear = season.where(fc.clear_sky("qa"))
    good = clear.groupBy("scene").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 110)
    return clear.join(good, "scene", "left_semi").groupBy("scene").agg(F.count(F.lit(1)).alias("n_clear"))


@query("illumination", f"WITH {fx.PIXEL_SQL} SELECT l_orderkey, l_linenumber, {r('lst', 'lst')}, {r('cos_i', 'cos_i')} FROM px")
def _(spark, sf):
    return fx.pixel_sample(spark, sf).select("l_orderkey", "l_linenumber", "lst", "cos_i")


# ---------------- binning and predicates ----------------


@query("age_bins", L + f"SELECT {n('bin', 'bin')}, {r('0.6::DOUBLE + bin + 0.5::DOUBLE', 'centre')}, {n('count(*)', 'n')}, {r('avg(dlst)', 'mean')} FROM post GROUP BY bin HAVING count(*) >= 10")
def _(spark, sf):
    p = fx.post_panel(spark, sf).withColumn("bin", bn.age_bin())
    out = p.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("dlst").alias("mean")).where(F.col("n") >= 10)
    return out.withColumn("centre", bn.bin_centre())


@query("floor_bins", L + f"SELECT {n('floor(age - 0.6::DOUBLE)', 'bin')}, {n('count(*)', 'n')} FROM post GROUP BY 1")
def _(spark, sf):
    return fx.post_panel(spark, sf).groupBy(bn.floor_bin().alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("trunc_clip_bins", L + f"SELECT {n('least(greatest(trunc(age), 1), 21)', 'bin')}, {n('count(*)', 'n')} FROM lp GROUP BY 1")
def _(spark, sf):
    return fx.long_panel(spark, sf).groupBy(bn.truncated_bin().alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("slice_bins", f"WITH {fx.PIXEL_SQL} SELECT {n('floor(elev / 250)', 'slice')}, {n('count(*)', 'n')}, {r('avg(lst)', 'lst')} FROM px GROUP BY 1")
def _(spark, sf):
    return fx.pixel_sample(spark, sf).groupBy(bn.height_slice().alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.avg("lst").alias("lst"))


ELEV = [("lt1000", 0, 1000), ("1000_2000", 1000, 2000), ("gt2000", 2000, 9999)]
AREA = [("lt2", 0, 2), ("2_10", 2, 10), ("ge10", 10, 1e9)]


@query("range_bands", U + f"SELECT CASE WHEN elev >= 0 AND elev < 1000 THEN 'lt1000' WHEN elev >= 1000 AND elev < 2000 THEN '1000_2000' WHEN elev >= 2000 AND elev < 9999 THEN 'gt2000' END AS elev_band, CASE WHEN area_ha < 2 THEN 'lt2' WHEN area_ha < 10 THEN '2_10' ELSE 'ge10' END AS area_band, {n('count(*)', 'n')} FROM unit GROUP BY 1, 2")
def _(spark, sf):
    u = fx.units(spark, sf)
    return u.groupBy(bn.band_of("elev", ELEV).alias("elev_band"), bn.band_of("area_ha", AREA).alias("area_band")).agg(F.count(F.lit(1)).alias("n"))


@query("value_histogram", f"SELECT {n('CASE WHEN l_quantity = 50 THEN 8 ELSE floor((l_quantity - 5) / 5) END', 'bin')}, {n('count(*)', 'n')} FROM lineitem WHERE l_quantity BETWEEN 5 AND 50 GROUP BY 1")
def _(spark, sf):
    px = fx.table(spark, sf, "lineitem", ["l_quantity"])
    b = bn.histogram_bin("l_quantity", 5, 5, 9)
    return px.withColumn("bin", b).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "tercile_classes",
    L + f", q AS (SELECT quantile_cont(area_ha, 1/3.0::DOUBLE) AS q1, quantile_cont(area_ha, 2/3.0::DOUBLE) AS q2 FROM post WHERE src = 'event') SELECT CASE WHEN area_ha < q1 THEN 'small' WHEN area_ha < q2 THEN 'medium' ELSE 'large' END AS cls, {n('count(*)', 'n')}, {r('min(area_ha)', 'lo')}, {r('max(area_ha)', 'hi')} FROM post, q WHERE src = 'event' GROUP BY 1",
)
def _(spark, sf):
    ev = fx.post_panel(spark, sf).where(F.col("src") == "event")
    out = size_classes(ev)
    return out.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("area_ha").alias("lo"), F.max("area_ha").alias("hi"))


def size_classes(ev):
    """Data-driven thirds of unit area; both cut points come from one selection."""
    from regrowth.operators.quantiles import exact_quantiles

    cuts = exact_quantiles(ev, [], "area_ha", [1 / 3, 2 / 3], ["q1", "q2"]).select(F.struct("q1", "q2").alias("q")).scalar()
    cut = ev.withColumn("_q", cuts)
    return cut.withColumn(
        "cls", F.when(F.col("area_ha") < F.col("_q.q1"), "small").when(F.col("area_ha") < F.col("_q.q2"), "medium").otherwise("large")
    ).drop("_q")


def usual_strata():
    ev = F.col("src") == "event"
    return [
        ("all", ev),
        ("typhoon", ev & (F.col("agent") == "typhoon_rain")),
        ("rainfall", ev & (F.col("agent") == "rainfall")),
        ("earthquake", ev & (F.col("agent") == "earthquake")),
        ("hansen", (F.col("src") == "hansen") & F.col("year").between(1990, 1998)),
        ("lt1000", ev & (F.col("elev") < 1000)),
        ("1000_2000", ev & (F.col("elev") >= 1000) & (F.col("elev") < 2000)),
        ("gt2000", ev & (F.col("elev") >= 2000)),
        ("lt2", ev & (F.col("area_ha") < 2)),
        ("2_10", ev & (F.col("area_ha") >= 2) & (F.col("area_ha") < 10)),
        ("ge10", ev & (F.col("area_ha") >= 10)),
    ]


STRATA_LIST = {
    "all": "src = 'event'",
    "typhoon": "src = 'event' AND agent = 'typhoon_rain'",
    "rainfall": "src = 'event' AND agent = 'rainfall'",
    "earthquake": "src = 'event' AND agent = 'earthquake'",
    "hansen": "src = 'hansen' AND year BETWEEN 1990 AND 1998",
    "lt1000": "src = 'event' AND elev < 1000",
    "1000_2000": "src = 'event' AND elev >= 1000 AND elev < 2000",
    "gt2000": "src = 'event' AND elev >= 2000",
    "lt2": "src = 'event' AND area_ha < 2",
    "2_10": "src = 'event' AND area_ha >= 2 AND area_ha < 10",
    "ge10": "src = 'event' AND area_ha >= 10",
}


def strata_sql(source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS stratum, * FROM {source} WHERE {v}" for k, v in STRATA_LIST.items())


@query("overlapping_strata", L + f", st AS ({strata_sql('post')}) SELECT stratum, {n('count(*)', 'n')}, {n('count(DISTINCT pid)', 'n_units')}, {r('avg(dlst)', 'dlst')} FROM st GROUP BY 1")
def _(spark, sf):
    rows = bn.strata_rows(fx.post_panel(spark, sf), usual_strata())
    return rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pid").alias("n_units"), F.avg("dlst").alias("dlst"))


@query(
    "common_support",
    L + f", g AS (SELECT yr <= 1998 AS early, min(age) AS lo, max(age) AS hi FROM post GROUP BY 1), w AS (SELECT max(lo) AS lo, min(hi) AS hi FROM g) SELECT CASE WHEN yr <= 1998 THEN 'early' ELSE 'late' END AS era_half, {n('count(*)', 'n')}, {r('min(age)', 'lo')}, {r('max(age)', 'hi')} FROM post, w WHERE age BETWEEN w.lo AND w.hi GROUP BY 1",
)
def _(spark, sf):
    p = fx.post_panel(spark, sf)
    half = F.when(F.col("yr") <= 1998, "early").otherwise("late")
    lo, hi = bn.common_support(p, half, "age")
    kept = p.where((F.col("age") >= lo) & (F.col("age") <= hi))
    return kept.groupBy(half.alias("era_half")).agg(F.count(F.lit(1)).alias("n"), F.min("age").alias("lo"), F.max("age").alias("hi"))


@query(
    "swath_grid",
    f"""WITH {fx.PIXEL_SQL} SELECT {n('floor((25.4::DOUBLE - (22 + elev / 1200)) / 0.02::DOUBLE)', 'iy')}, {n('floor((120 + chm / 25 - 119.9::DOUBLE) / 0.02::DOUBLE)', 'ix')}, {n('count(*)', 'n')}, {r('avg(lst)', 'lst', 9)} FROM px GROUP BY 1, 2""",
    9,
)
def _(spark, sf):
    px = fx.pixel_sample(spark, sf)
    iy, ix = bn.grid_cell(120 + F.col("chm") / 25, 22 + F.col("elev") / 1200, 119.9, 25.4, 0.02)
    return px.groupBy(iy.alias("iy"), ix.alias("ix")).agg(F.count(F.lit(1)).alias("n"), F.avg("lst").alias("lst"))


@query(
    "isin_contains_between",
    L + f"SELECT src, {n('count(*)', 'n')} FROM lp WHERE agent IN ('rainfall', 'typhoon_rain') AND coalesce(contains(event, '颱風'), false) AND yr BETWEEN 1996 AND 1999 AND dndvi IS NOT NULL GROUP BY 1",
)
def _(spark, sf):
    lp = fx.long_panel(spark, sf)
    keep = F.col("agent").isin("rainfall", "typhoon_rain") & fc.contains_or_false("event", "颱風") & F.col("yr").between(1996, 1999) & F.col("dndvi").isNotNull()
    return lp.where(keep).groupBy("src").agg(F.count(F.lit(1)).alias("n"))
