import random
import statistics

import pytest

from regrowth.operators import models as ml, quantiles as qt
from regrowth.plans import catalogue, effects, fixtures as fx

FEATURES = ["x", "y"]


def rows(n, seed=4):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        x, y = float(rnd.randint(0, 9)), rnd.random()
        out.append((x, y, 3.0 * (x >= 4) + (y > 0.5) + rnd.gauss(0, 0.1), "ab"[int(x) % 2]))
    return out


def test_cells_hold_every_row_and_bound_what_trees_read(spark):
    data = rows(6000)
    df = spark.createDataFrame(data, "x double, y double, lst double, g string")
    edges = ml.bin_edges(df, FEATURES)
    assert edges[0] == [float(v) for v in range(1, 10)] and len(edges[1]) == ml.BINS - 1
    held = ml.cells(df, FEATURES, "lst", edges).collect()
    assert len(held) <= 10 * ml.BINS and sum(r.n for r in held) == len(data)
    assert abs(sum(r.n * r.lst for r in held) - sum(r[2] for r in data)) < 1e-6
    model = ml.fit_boosted(df, FEATURES, "lst", rounds=8, depth=4)
    got = ml.predict(model, df, FEATURES).select("lst", "prediction").collect()
    mean = statistics.fmean(r[2] for r in data)
    assert 1 - sum((r.lst - r.prediction) ** 2 for r in got) / sum((r[2] - mean) ** 2 for r in data) > 0.97


def test_a_node_has_at_least_fifty_rows_not_cells(spark):
    for few, differs in ((49, False), (50, True)):
        df = spark.createDataFrame([(float(i < few), 0.0, float(i < few)) for i in range(200)], "x double, y double, lst double")
        model = ml.fit_boosted(df, FEATURES, "lst", rounds=2, depth=2)
        got = {r.prediction for r in ml.predict(model, df, FEATURES).select("prediction").collect()}
        assert (len(got) == 2) == differs


def test_typical_rows_from_counted_values(spark):
    data = rows(901)
    df = spark.createDataFrame(data, "x double, y double, lst double, g string")
    got = {r.g: r for r in ml.typical_rows(df, ["g"], FEATURES, {"low": ("x", 0.1)}).collect()}
    for g in "ab":
        own = [r for r in data if r[3] == g]
        xs = sorted(r[0] for r in own)
        at = 0.1 * (len(xs) - 1)
        assert got[g].x == statistics.median(xs) and abs(got[g].y - statistics.median(r[1] for r in own)) < 1e-12
        assert abs(got[g].low - (xs[int(at)] + (xs[min(int(at) + 1, len(xs) - 1)] - xs[int(at)]) * (at - int(at)))) < 1e-12
    one = qt.exact_quantiles(df, [], "x", [0.5], ["m"], count="n", repeated=True).first()
    assert (one.m, one.n) == (statistics.median(r[0] for r in data), 901)


@pytest.mark.parametrize("name", ["gbt_model", "partial_dependence", "counterfactual"])
def test_height_queries_boost_all_rounds_of_the_method(spark, monkeypatch, name):
    class Asked(Exception):
        pass

    def regressor(**settings):
        raise Asked(settings)

    px = spark.createDataFrame([(k, 1, float(k % 7), *[float(k % m) for m in range(2, 8)]) for k in range(400)], ["l_orderkey", "l_linenumber", "lst", *effects.FEATS])
    monkeypatch.setattr(fx, "pixel_sample", lambda spark, sf: px)
    monkeypatch.setattr(ml, "GBTRegressor", regressor)
    with pytest.raises(Asked) as asked:
        catalogue.QUERIES[name](spark, "")
    settings = asked.value.args[0]
    assert (settings["maxIter"], settings["stepSize"], settings["maxDepth"]) == (400, 0.08, 5)


def test_rounds_are_cut_by_checkpoints_without_a_setting_of_the_session(spark):
    df = spark.createDataFrame(rows(300), "x double, y double, lst double, g string").coalesce(1)
    ml.fit_boosted(df, FEATURES, "lst", rounds=1, depth=1)
    assert spark.sparkContext.getCheckpointDir() is not None
