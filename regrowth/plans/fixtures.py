"""The panel, pixel grid, scenes and samples that the queries use, all derived from the given tables.

``*_SQL`` are the same definitions for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from regrowth.functions import columns as fc
from regrowth.functions.draws import uniform
from regrowth.sources.tables import scan_table

YEARS = list(range(1995, 2002))
PERIODS = {f"c{y % 100:02d}": y + 0.62 for y in YEARS}
GRID_WIDTH = 100
QA_WORDS = [0, 1, 8, 64, 21824]  # fixed values: fill, clear, cloud, clear, clear
KEEP = ["pid", "src", "agent", "era", "dq", "event", "year", "elev", "slope", "area_ha", "n_px", "redist_frac", "clean"]


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    return scan_table(spark, f"{sf_dir}/{name}.parquet", columns)


def units(spark, sf) -> DataFrame:
    """One disturbed unit per customer."""
    df = table(spark, sf, "customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    p = F.col("c_custkey")
    base = F.when(p % 3 == 0, "颱風").when(p % 3 == 1, "豪雨").otherwise("地震")
    stamp = F.when(
        p % 2 == 0, F.concat(F.lpad((p % 12 + 1).cast("string"), 2, "0"), F.lpad((p % 28 + 1).cast("string"), 2, "0"))
    ).otherwise("")
    name = F.concat(
        stamp, base, F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), (p % 5 + 1).cast("int")),
        F.when(p % 10 == 9, "、0721豪雨").otherwise(""),
    )
    out = df.select(
        p.alias("pid"),
        F.col("c_nationkey").cast("long").alias("nat"),
        F.when(F.col("c_nationkey") % 5 == 0, "hansen").otherwise("event").alias("src"),
        F.when(p % 59 == 0, F.lit(None).cast("string"))
        .when(p % 53 == 0, "")
        .when(p % 3 == 0, "typhoon_rain")
        .when(p % 3 == 1, "rainfall")
        .otherwise("earthquake")
        .alias("agent"),
        (F.lit(1988.0) + F.lit(12.0) * uniform(F.lit("t"), p)).alias("t_event"),
        ((F.col("c_acctbal") + 1000) / 11000 * 3600).alias("elev"),
        ((p % 35).cast("double")).alias("slope"),
        (F.lit(0.5) + (p % 40) * 0.5).alias("area_ha"),
        ((p % 25) / 400.0).alias("redist_frac"),
        (p % 60 + 20).alias("n_ctrl"),
        (F.lit(0.5) + (p % 50) / 100.0).alias("forest2000_frac"),
        (p % 200 + 10).alias("n_px"),
        F.when(p % 31 != 0, name).alias("event"),
        F.element_at(F.array(F.lit("canonical"), F.lit("mmdd"), F.lit("midpoint"), F.lit("yearmid")), (p % 4 + 1).cast("int")).alias("dq"),
    )
    out = out.withColumn("year", F.floor("t_event").cast("long"))
    return out.withColumns(
        {
            "era": F.when(F.col("year") <= 1993, "annual").otherwise("event"),
            "clean": fc.clean_flag(),
            "pre_tag": fc.pre_tag("year", "t_event", 1996, 2001),
        }
    )


UNIT_SQL = """unit0 AS (
  SELECT c_custkey AS pid, CAST(c_nationkey AS BIGINT) AS nat,
    CASE WHEN c_nationkey % 5 = 0 THEN 'hansen' ELSE 'event' END AS src,
    CASE WHEN c_custkey % 59 = 0 THEN NULL WHEN c_custkey % 53 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN 'typhoon_rain'
         WHEN c_custkey % 3 = 1 THEN 'rainfall' ELSE 'earthquake' END AS agent,
    1988.0::DOUBLE + 12.0::DOUBLE * (('0x' || substr(md5('t-' || c_custkey), 1, 8))::UBIGINT / 4294967296.0::DOUBLE) AS t_event,
    (c_acctbal + 1000) / 11000 * 3600 AS elev,
    CAST(c_custkey % 35 AS DOUBLE) AS slope,
    0.5::DOUBLE + (c_custkey % 40) * 0.5::DOUBLE AS area_ha,
    (c_custkey % 25) / 400.0::DOUBLE AS redist_frac,
    c_custkey % 60 + 20 AS n_ctrl,
    0.5::DOUBLE + (c_custkey % 50) / 100.0::DOUBLE AS forest2000_frac,
    c_custkey % 200 + 10 AS n_px,
    CASE WHEN c_custkey % 31 <> 0 THEN
      (CASE WHEN c_custkey % 2 = 0 THEN lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0') || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') ELSE '' END)
      || (CASE c_custkey % 3 WHEN 0 THEN '颱風' WHEN 1 THEN '豪雨' ELSE '地震' END)
      || substr('ABCDE', CAST(c_custkey % 5 + 1 AS INTEGER), 1)
      || (CASE WHEN c_custkey % 10 = 9 THEN '、0721豪雨' ELSE '' END) END AS event,
    CASE c_custkey % 4 WHEN 0 THEN 'canonical' WHEN 1 THEN 'mmdd' WHEN 2 THEN 'midpoint' ELSE 'yearmid' END AS dq
  FROM customer),
unit AS (
  SELECT *, CAST(floor(t_event) AS BIGINT) AS year,
    CASE WHEN floor(t_event) <= 1993 THEN 'annual' ELSE 'event' END AS era,
    redist_frac < 0.05 AND n_ctrl >= 30 AND forest2000_frac > 0.6 AS clean,
    CASE WHEN floor(t_event) BETWEEN 1996 AND 2001 THEN 'c' || lpad((CAST(floor(t_event) AS BIGINT) - 1) % 100, 2, '0') ELSE '' END AS pre_tag
  FROM unit0)"""
UNIT_SQL = UNIT_SQL.replace("lpad((CAST(floor(t_event) AS BIGINT) - 1) % 100, 2, '0')", "lpad(((CAST(floor(t_event) AS BIGINT) - 1) % 100)::VARCHAR, 2, '0')")


def long_panel(spark, sf) -> DataFrame:
    """One row per unit and observed year; the control level is the mean of the same nation and year."""
    u = units(spark, sf)
    orders = table(spark, sf, "orders", ["o_custkey", "o_totalprice", "o_orderdate"])
    yearly = (
        orders.groupBy(F.col("o_custkey").alias("pid"), F.year("o_orderdate").cast("long").alias("yr"))
        .agg(F.avg("o_totalprice").alias("v"))
        .join(u, "pid")
    )
    control = yearly.groupBy("nat", "yr").agg(F.avg("v").alias("ctl"))
    df = yearly.join(control, ["nat", "yr"]).withColumn("age", F.col("yr") + F.lit(0.62) - F.col("t_event"))
    hot = F.when(F.col("age") > 0, 3.0 * F.exp(-F.col("age") / 8)).otherwise(0.0)
    green = F.when(F.col("age") > 0, 0.35 * F.exp(-F.col("age") / 6)).otherwise(0.0)
    return df.withColumns(
        {
            "dlst": (F.col("v") - F.col("ctl")) / 1e6 + hot,
            "dndvi": F.when((F.col("pid") * 7 + F.col("yr")) % 11 != 0, (F.col("ctl") - F.col("v")) / 1e7 - green),
            "epoch": fc.period_tag("yr"),
            "is_pre": fc.period_tag("yr") == F.col("pre_tag"),
        }
    )


LONG_SQL = (
    UNIT_SQL
    + """,
yv AS (SELECT o_custkey AS pid, CAST(year(o_orderdate) AS BIGINT) AS yr, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2),
yu AS (SELECT unit.*, yr, v FROM yv JOIN unit USING (pid)),
ctl AS (SELECT nat, yr, avg(v) AS ctl FROM yu GROUP BY 1, 2),
lp0 AS (SELECT yu.*, ctl.ctl, yr + 0.62::DOUBLE - t_event AS age FROM yu JOIN ctl USING (nat, yr)),
lp AS (SELECT *, (v - ctl) / 1e6 + CASE WHEN age > 0 THEN 3.0::DOUBLE * exp(-age / 8) ELSE 0 END AS dlst,
    CASE WHEN (pid * 7 + yr) % 11 <> 0 THEN (ctl - v) / 1e7 - CASE WHEN age > 0 THEN 0.35::DOUBLE * exp(-age / 6) ELSE 0 END END AS dndvi,
    'c' || lpad((yr % 100)::VARCHAR, 2, '0') AS epoch,
    ('c' || lpad((yr % 100)::VARCHAR, 2, '0')) = pre_tag AS is_pre FROM lp0),
post AS (SELECT *, CASE WHEN age < 0.6::DOUBLE + floor(age - 0.6::DOUBLE) THEN floor(age - 0.6::DOUBLE) - 1
      WHEN age >= 0.6::DOUBLE + floor(age - 0.6::DOUBLE) + 1 THEN floor(age - 0.6::DOUBLE) + 1
      ELSE floor(age - 0.6::DOUBLE) END AS bin
    FROM lp WHERE NOT is_pre AND clean AND age > 0.6 AND age <= 22)"""
)


def post_panel(spark, sf, max_age: float | None = 22.0) -> DataFrame:
    return long_panel(spark, sf).where(fc.after_event(max_age))


def wide_panel(spark, sf) -> DataFrame:
    from regrowth.operators.reshape import long_to_wide

    long = long_panel(spark, sf)
    values = long_to_wide(long, ["pid"], "epoch", list(PERIODS), ["dlst", "dndvi"])
    return units(spark, sf).join(values, "pid")


WIDE_SQL = (
    LONG_SQL
    + ",\nwide AS (SELECT unit.*, "
    + ", ".join(f"w.{v}_{p}" for p in PERIODS for v in ("dlst", "dndvi"))
    + " FROM unit JOIN (SELECT pid, "
    + ", ".join(f"max(CASE WHEN epoch = '{p}' THEN {v} END) AS {v}_{p}" for p in PERIODS for v in ("dlst", "dndvi"))
    + " FROM lp GROUP BY pid) w USING (pid))"
)


def pixel_sample(spark, sf) -> DataFrame:
    """Intact-area pixels from lineitem: height, terrain and temperature."""
    df = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return df.select(
        "l_orderkey",
        F.col("l_linenumber").cast("long").alias("l_linenumber"),
        (F.col("l_extendedprice") / 1e4 - 0.05 * F.col("l_quantity")).alias("lst"),
        F.col("l_quantity").alias("chm"),
        ((F.col("l_partkey") * 37 % 3600).cast("double") + 0.5).alias("elev"),
        (F.col("l_discount") * 100).alias("slope"),
        (F.col("l_tax") * 10 - 0.4).alias("northness"),
        F.cos(F.col("l_orderkey") % 360).alias("eastness"),
        fc.illumination(F.col("l_discount") * 100, F.cos(F.col("l_orderkey") % 360), F.col("l_tax") * 10 - 0.4).alias("cos_i"),
    )


PIXEL_SQL = """px AS (SELECT *,
    cos(radians(slope)) * sin(radians(62.5::DOUBLE)) + sin(radians(slope)) * cos(radians(62.5::DOUBLE))
      * cos(radians(107.5::DOUBLE) - atan2(eastness, northness)) AS cos_i FROM (
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice / 1e4 - 0.05::DOUBLE * l_quantity AS lst,
    l_quantity AS chm, CAST(l_partkey * 37 % 3600 AS DOUBLE) + 0.5::DOUBLE AS elev, l_discount * 100 AS slope,
    l_tax * 10 - 0.4::DOUBLE AS northness, cos(CAST(l_orderkey % 360 AS DOUBLE)) AS eastness FROM lineitem))"""


def pixel_grid(spark, sf) -> DataFrame:
    """One cell per order on a grid of fixed width: terrain, disturbance year and a temperature."""
    o = table(spark, sf, "orders", ["o_orderkey", "o_totalprice", "o_orderdate"])
    k = F.col("o_orderkey")
    df = o.select(
        F.floor(k / GRID_WIDTH).cast("long").alias("row"), (k % GRID_WIDTH).alias("col"),
        F.col("o_totalprice").alias("price"), F.year("o_orderdate").cast("long").alias("yr"),
    )
    block = uniform(F.lit("b"), F.floor(F.col("row") / 4).cast("long"), F.floor(F.col("col") / 5).cast("long"))
    return df.withColumn("u", block).select(
        "row", "col",
        (F.lit(800.0) + 9.0 * (F.col("row") % 60) + 6.0 * F.col("col") + F.col("price") / 1e4).alias("elev"),
        (F.lit(5.0) + F.col("price") / 2e4).alias("slope"),
        (F.lit(25.0) - F.col("price") / 1e5 + F.when(F.col("u") < 0.12, 3.0).otherwise(0.0)).alias("lst"),
        "yr",
        (F.col("u") < 0.12).alias("disturbed"),
    )


GRID_SQL = f"""grid AS (SELECT "row", "col", 800.0::DOUBLE + 9.0::DOUBLE * ("row" % 60) + 6.0::DOUBLE * "col" + price / 1e4 AS elev,
    5.0::DOUBLE + price / 2e4 AS slope, 25.0::DOUBLE - price / 1e5 + CASE WHEN u < 0.12 THEN 3.0::DOUBLE ELSE 0 END AS lst, yr,
    u < 0.12 AS disturbed FROM (
  SELECT *, ('0x' || substr(md5('b-' || CAST(floor("row" / 4) AS BIGINT) || '-' || CAST(floor("col" / 5) AS BIGINT)), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM (
    SELECT CAST(floor(o_orderkey / {GRID_WIDTH}) AS BIGINT) AS "row", o_orderkey % {GRID_WIDTH} AS "col", o_totalprice AS price,
      CAST(year(o_orderdate) AS BIGINT) AS yr FROM orders)))"""


def scenes(spark, sf) -> DataFrame:
    """Observations of cells in scenes from the events table: quality bits and raw counts."""
    e = table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return e.select(
        "event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("scene"), F.col("user_id").alias("cell"),
        F.concat(F.lit("w"), F.floor((F.dayofmonth("ts") - 1) / 10).cast("string")).alias("epoch"),
        F.col("event_type").alias("sensor"), F.element_at(F.array(*[F.lit(b) for b in QA_WORDS]), (F.col("event_id") % 5 + 1).cast("int")).alias("qa"), F.col("value"),
        (F.lit(43000) + F.floor(F.col("value") * 10)).alias("st"),
        (F.lit(7500) + F.floor(F.col("value") * 3)).alias("red"),
        (F.lit(12000) + F.col("event_id") % 900).alias("nir"),
    )


SCENE_SQL = """sc AS (SELECT event_id, ts, strftime(ts, '%Y-%m-%d') AS scene, user_id AS cell,
    'w' || CAST(floor((day(ts) - 1) / 10) AS BIGINT) AS epoch, event_type AS sensor, [0, 1, 8, 64, 21824][event_id % 5 + 1] AS qa, value,
    CAST(43000 + floor(value * 10) AS BIGINT) AS st, CAST(7500 + floor(value * 3) AS BIGINT) AS red, 12000 + event_id % 900 AS nir
  FROM events),
clear AS (SELECT * FROM sc WHERE qa <> 0 AND (qa & 62) = 0)"""
