"""Hand-made edge cases of the column expressions and bins."""

import datetime as dt
import math

from pyspark.sql import functions as F

from regrowth.functions import columns as fc
from regrowth.operators import aggregate as ag
from regrowth.operators import binning as bn
from regrowth.sources.tables import nan_to_null


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_half_even(spark):
    got = one(spark, [(0.5,), (1.5,), (2.5,), (-0.5,), (3.49,)], "x double", fc.half_even("x"))
    assert [g[0] for g in got] == [0, 2, 2, 0, 3]


def test_age_bin_edges(spark):
    edges = [0.6 + k for k in range(22)]
    got = one(spark, [(e,) for e in edges] + [(math.nextafter(e, 0),) for e in edges[1:]], "age double", bn.age_bin())
    assert [g[0] for g in got[:22]] == list(range(22))
    assert [g[0] for g in got[22:]] == list(range(21))


def test_truncated_bin_differs_from_floor(spark):
    got = one(spark, [(-0.9,), (0.7,), (1.99,), (40.0,)], "age double", bn.truncated_bin(), bn.floor_bin())
    assert got == [(1, -2), (1, 0), (1, 1), (21, 39)]


def test_histogram_last_bin_closed(spark):
    got = one(spark, [(5.0,), (10.0,), (50.0,), (50.1,), (4.9,)], "x double", bn.histogram_bin("x", 5, 5, 9))
    assert [g[0] for g in got] == [0, 1, 8, None, None]


def test_dates(spark):
    rows = [("20090808",), ("2009/8/8",), (" 2009-08-08 extra",), ("n/a",), (None,), ("20091399",)]
    got = one(spark, rows, "s string", fc.parse_date("s"))
    d = dt.date(2009, 8, 8)
    assert [g[0] for g in got] == [d, d, d, None, None, None]


def test_decimal_year_round_trip(spark):
    days = [(dt.date(2009, 1, 1),), (dt.date(2009, 8, 8),), (dt.date(2012, 12, 31),)]
    got = one(spark, days, "d date", "d", fc.date_of_decimal_year(fc.decimal_year("d")))
    assert all(abs((a - b).days) <= 1 for a, b in got)


def test_clear_sky(spark):
    got = one(spark, [(0,), (1,), (2,), (62,), (64,), (21824,)], "qa int", fc.clear_sky("qa"))
    assert [g[0] for g in got] == [False, True, False, False, True, True]


def test_trigger_order_and_missing(spark):
    rows = [("0206地震",), ("颱風暨豪雨",), ("熱帶低壓",), ("堰塞湖",), (None,), ("x",)]
    got = one(spark, rows, "e string", fc.trigger_of("e"))
    assert [g[0] for g in got] == ["earthquake", "typhoon_rain", "rainfall", "other", "unknown", "unknown"]


def test_clean_flag_never_null(spark):
    rows = [(0.01, 30, 0.61), (0.05, 30, 0.9), (0.01, 29, 0.9), (0.01, 30, 0.6), (None, 30, 0.9)]
    got = one(spark, rows, "redist_frac double, n_ctrl int, forest2000_frac double", fc.clean_flag())
    assert [g[0] for g in got] == [True, False, False, False, False]


def test_missing_groups_drop(spark):
    df = spark.createDataFrame([("a", 1.0)] * 8 + [("", 1.0)] * 9 + [(None, 1.0)] * 9 + [("b", 2.0)] * 7, "agent string, y double")
    got = ag.mean_se(ag.named_groups(df, "agent"), ["agent"], "y", 8).collect()
    assert [(r.agent, r.n) for r in got] == [("a", 8)]


def test_nan_becomes_null(spark):
    df = nan_to_null(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double"))
    assert df.agg(F.count("x"), F.avg("x")).first() == (1, 1.0)
