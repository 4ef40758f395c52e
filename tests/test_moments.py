import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from regrowth.operators import fixed_effects as fe
from regrowth.operators import regression as rg
from regrowth.operators.moments import Moments, part_of
from regrowth.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    n = 4000
    d = pd.DataFrame({"g": rng.integers(0, 3, n), "h": rng.uniform(10, 40, n), "a": rng.normal(1e5, 3, n), "b": rng.normal(size=n)})
    d["y"] = 5.0 * d.g + 0.4 * d.a - d.b + 0.05 * d.h + rng.normal(size=n)
    return d


def test_parts_merge_exactly(spark, rows):
    m = Moments(["y", "a", "b"])
    parts = m.by_part(spark.createDataFrame(rows), ["g"], F.when(F.col("h") < 20, "low").when(F.col("h") < 25, "mid").otherwise("rest"))
    got = parts.select("g", m.total(F.col("parts")).alias("t"), part_of(F.col("parts"), "mid")["n"].alias("mid"), part_of(F.col("parts"), "no").alias("none")).toPandas()
    for _, r in got.iterrows():
        d = rows[rows.g == r.g]
        x = d[["y", "a", "b"]].to_numpy()
        full = (x - x.mean(0)).T @ (x - x.mean(0))
        assert r.t["n"] == len(d) and r.mid == ((d.h >= 20) & (d.h < 25)).sum() and r.none is None
        np.testing.assert_allclose(r.t["mean"], x.mean(0), rtol=1e-12)
        np.testing.assert_allclose(r.t["cross"], full[np.triu_indices(3)], rtol=1e-9)


def residual(d, xs):
    x = np.column_stack([d[xs], np.ones(len(d))])
    x[:, :-1] -= x[:, :-1].mean(0)
    return d.y - x @ np.linalg.lstsq(x, d.y, rcond=None)[0]


def test_residual_statistics_without_rows(spark, rows):
    df = spark.createDataFrame(rows)
    got = rg.residual_moments(df, ["g"], "y", ["a", "b"], "h", recentre=True).toPandas().set_index("g")
    win = rg.residual_windows(df, ["g"], "y", {"one": ["a"], "two": ["a", "b"]}, "h", 15.0, 20.0, 25.0, 50, ddof=1).toPandas().set_index(["g", "model"])
    for g, d in rows.groupby("g"):
        res = residual(d, ["a", "b"]) + d.y.mean()
        slope, intercept = np.polyfit(d.h, res, 1)
        np.testing.assert_allclose(got.loc[g, ["mean", "slope", "intercept", "r"]].astype(float), [d.y.mean(), slope, intercept, np.corrcoef(d.h, res)[0, 1]], rtol=1e-6)
        np.testing.assert_allclose(got.loc[g, "rms"], np.sqrt((res**2).mean()), rtol=1e-9)
        for model, xs in (("one", ["a"]), ("two", ["a", "b"])):
            res = residual(d, xs)
            a, b = res[(d.h >= 15) & (d.h < 20)], res[(d.h >= 20) & (d.h < 25)]
            want = [2 * (b.mean() - a.mean()), 2 * np.sqrt(a.var() / len(a) + b.var() / len(b))]
            np.testing.assert_allclose(win.loc[(g, model), ["slope", "se"]].astype(float), want, rtol=1e-6)


def test_nulls_and_no_rows(spark, rows):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, None, 3.0), (1, 3.0, 5.0), (2, None, None)], "g long, y double, a double")
    got = Moments(["y", "a"]).table(df, ["g"]).collect()
    assert [(r.g, r.n, r.mean, r.cross) for r in got] == [(1, 2, [2.0, 3.5], [2.0, 3.0, 4.5])]
    assert rg.residual_moments(df.limit(0), ["g"], "y", ["a"], "a").count() == 0
    assert fe.two_way(df.limit(0).withColumn("p", F.lit("x")), "g", "p", "y", "a", ["x", "z"]).first().n_rows is None


def test_rows_are_read_once(spark):
    plan = lambda name: QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    for name in ("slice_sensitivity", "terrain_residual", "terrain_recentred"):
        assert plan(name).count("l_orderkey#") > 0 and sum("Relation [" in x and "l_orderkey" in x for x in plan(name).splitlines()) == 1, name
    # units enough alone decide the joins: the rows meet their units once, to be kept, and are never joined with their means
    assert sum("Join" in x for x in plan("fe_two_way").splitlines()) == sum("Join" in x for x in plan("fe_beta").splitlines())
