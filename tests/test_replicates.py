import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regrowth.operators import bootstrap as bt
from regrowth.operators import fixed_effects as fe
from regrowth.operators import replicates as rp
from regrowth.plans.catalogue import QUERIES


def test_binomial_quantile_is_the_distribution():
    rng = np.random.default_rng(1)
    for n, p in ((1, 0.3), (7, 0.5), (40, 0.02), (500, 0.31), (20_000, 0.5)):
        draws = np.array([rp.binomial_quantile(n, p, u) for u in rng.random(4000)])
        assert abs(draws.mean() - n * p) < 5 * np.sqrt(n * p * (1 - p) / 4000) and abs(draws.var() / (n * p * (1 - p)) - 1) < 0.15
        assert draws.min() >= 0 and draws.max() <= n
    assert [rp.binomial_quantile(*x) for x in ((0, 0.5, 0.9), (9, 0.0, 0.9), (9, 1.0, 0.1), (5, 0.5, 0.0), (5, 0.5, 1.0))] == [0, 0, 9, 0, 5]


def test_slices_share_out_every_draw():
    for sizes in ([5, 0, 7, 3], [1] * 8, [100, 0, 0, 0, 0, 0, 0, 1]):
        for rep in range(1, 30):
            shares = [rp.slice_share("s", rep, sizes, k) for k in range(len(sizes))]
            assert sum(shares) == sum(sizes) and all(s == 0 for s, n in zip(shares, sizes) if n == 0)


def test_multinomial_counts_look_multinomial(spark):
    units = spark.createDataFrame([(f"u{i}",) for i in range(40)], "u string")
    w = bt.replicate_weights(units, "u", 500, "z").toPandas()
    assert set(w.groupby("rep").w.sum()) == {40} and w.u.nunique() == 40
    table = w.pivot(index="rep", columns="u", values="w").fillna(0)
    assert abs(table.to_numpy().var() - (1 - 1 / 40)) < 0.05 and abs(table.corr().to_numpy()[np.triu_indices(40, 1)].mean() + 1 / 39) < 0.01
    assert bt.replicate_weights(units.limit(0), "u", 5, "z").count() == 0


@pytest.mark.parametrize("scheme", ["multinomial", "poisson"])
def test_vectors_equal_weighted_rows(spark, scheme):
    rng = np.random.default_rng(2)
    d = pd.DataFrame({"u": rng.integers(0, 50, 400), "g": rng.choice(["a", "b", None], 400), "y": rng.normal(size=400)})
    d.loc[:120, "u"] = 7  # one unit holds a third of the rows
    df = spark.createDataFrame(d).repartition(3)
    sums = df.groupBy("u", "g").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    got = rp.replicate_sums(sums, "u", ["g"], ["n", "s"], 20, "q", scheme).toPandas()
    w = bt.replicate_weights(df.select("u").distinct(), "u", 20, "q", scheme).toPandas()
    m = d.merge(w, on="u")
    want = m.assign(n=m.w, s=m.w * m.y, g=m.g.fillna("-")).groupby(["rep", "g"])[["n", "s"]].sum()
    have = got.assign(g=got.g.fillna("-")).set_index(["rep", "g"]).sort_index()
    np.testing.assert_allclose(have[["n", "s"]].to_numpy(float), want.sort_index().to_numpy(float), rtol=1e-12, atol=1e-9)
    once = m.drop_duplicates(["rep", "g", "u"]).assign(g=lambda x: x.g.fillna("-"))
    assert (once.groupby(["rep", "g"]).w.sum().sort_index() == have.draws).all() and (once.groupby(["rep", "g"]).size().sort_index() == have.n_units).all()
    one = rp.replicate_sums(sums.groupBy("u").agg(F.array(F.sum("n"), F.sum("s")).alias("v")), "u", [], ["v"], 20, "q", scheme).orderBy("rep").toPandas()
    np.testing.assert_allclose(np.stack(one.v), m.assign(n=m.w, s=m.w * m.y).groupby("rep")[["n", "s"]].sum().to_numpy(float), rtol=1e-9, atol=1e-9)
    assert rp.replicate_sums(sums.limit(0), "u", ["g"], ["n", "s"], 5, "q", scheme).count() == 0


def test_own_statistic(spark):
    rng = np.random.default_rng(3)
    d = pd.DataFrame({"u": np.arange(300), "g": np.arange(300) % 2, "y": rng.gamma(4.0, 1.0, 300)})
    n, mean = F.col("n"), F.col("s") / F.col("n")
    spread = F.sqrt(F.col("q") / n - mean * mean) / mean  # coefficient of variation
    terms = {"n": F.lit(1), "s": F.col("y"), "q": F.col("y") * F.col("y")}
    got = bt.statistic(spark.createDataFrame(d), "u", ["g"], terms, spread, 200, "cv").toPandas().set_index("g")
    for g, part in d.groupby("g"):
        point = part.y.std(ddof=0) / part.y.mean()
        boot = [(lambda s: s.std(ddof=0) / s.mean())(part.y.sample(len(part), replace=True, random_state=i)) for i in range(400)]
        lo, hi = np.percentile(boot, [2.5, 97.5])
        assert abs(got.loc[g, "point"] - point) < 1e-9 and abs(got.loc[g, "lo"] - lo) < 0.03 and abs(got.loc[g, "hi"] - hi) < 0.03


def test_numbers_are_those_of_the_columns(spark):
    from regrowth.functions.draws import uniform

    row = spark.range(1).select(uniform(F.lit("k"), F.lit(12), F.lit(3)).alias("u")).first()
    assert row.u == rp.keyed("k-12-3") == int(hashlib.md5(b"k-12-3").hexdigest()[:8], 16) / 2**32


def test_no_rows_per_unit_and_replicate(spark):
    """Nothing is exploded over replicates before the vectors are added up."""
    for name in ("multinomial_weights", "cluster_bootstrap", "recovery_clock_ci"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
        grows = [i for i, x in enumerate(plan) if "Generate inline" in x or "Generate explode" in x]
        vectors = [i for i, x in enumerate(plan) if "MapInArrow" in x or "FlatMapGroupsInArrow" in x]
        assert vectors and grows and min(grows) < min(vectors), name  # a plan lists the last step first


def test_within_vectors(spark):
    rng = np.random.default_rng(4)
    d = pd.DataFrame({"pid": rng.integers(0, 12, 200), "age": rng.integers(1, 20, 200) + 0.5})
    d["y"] = 2 * np.exp(-d.age / 5) + rng.normal(0, 0.3, 200)
    taus = fe.tau_grid(1, 60, 0.5)
    got = fe.unit_vectors(spark.createDataFrame(d), "pid", "y", "age", taus, 5.0).toPandas().set_index("pid")
    for pid, p in d.groupby("pid"):
        g, y, a = np.exp(-p.age / 5), p.y - p.y.mean(), p.age - p.age.mean()
        g = g - g.mean()
        cost = [((p.y - (p.y @ w) / (w @ w) * w) ** 2).sum() for w in (np.exp(-p.age / t) for t in taus)]
        np.testing.assert_allclose(got.loc[pid, "v"], [len(p), y @ g, g @ g, y @ a, a @ a, *cost], rtol=1e-8, atol=1e-9)
    assert Counter(d.pid) == {k: v[0] for k, v in got.v.items()}


def test_cells_of_many_units_stay_arrays():
    """Memory of a slice is that of its numbers, not of an object for each cell."""
    import tracemalloc

    import pyarrow as pa

    n, rng = 20_000, np.random.default_rng(5)
    units, keys, values = np.repeat(np.arange(n), 8), rng.choice(["a", "b", None], 8 * n), rng.normal(size=(8 * n, 3))
    flat = pa.StructArray.from_arrays([pa.StructArray.from_arrays([pa.array(keys)], ["g"]), pa.FixedSizeListArray.from_arrays(values.ravel(), 3).cast(pa.list_(pa.float64()))], ["key", "v"])
    table = pa.table({"_cells": pa.ListArray.from_arrays(np.arange(0, 8 * n + 1, 8, dtype=np.int32), flat)})
    order, weights = rng.permutation(n), rng.integers(0, 4, (n, 16)).astype(float)
    tracemalloc.start()
    held = rp._Vectors(16)
    held.add(rp._Cells(table.column("_cells").combine_chunks(), order), 0, weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    place = np.argsort(order)
    for g in ("a", "b", None):
        at = np.array([k is g or k == g for k in keys])
        w = weights[place[units[at]]]
        np.testing.assert_allclose(held.held[(g,)], np.column_stack([w.T @ values[at], w.sum(axis=0), (w > 0).sum(axis=0)]), rtol=1e-9, atol=1e-9)
    assert peak < 40e6
