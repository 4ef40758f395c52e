"""Operators against brute force in numpy on small fixtures."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regrowth.functions.small_math import chi2_tail, solve_normal, t_two_sided
from regrowth.operators import binning as bn
from regrowth.operators import bootstrap as bt
from regrowth.operators import event_study as es
from regrowth.operators import fitting as ft
from regrowth.operators import fixed_effects as fe
from regrowth.operators import quantiles as qt
from regrowth.operators import ranking as rk
from regrowth.operators import regression as rg
from regrowth.operators import reshape as rs
from regrowth.operators import spatial as sp
from regrowth.operators import verify as vf
from regrowth.sources import tables as tb


@pytest.fixture(scope="module")
def panel(spark):
    """Known amplitude 3 and tau 8 with unit effects of zero and small noise."""
    rng = np.random.default_rng(1)
    rows = []
    for pid in range(60):
        t0 = 1990 + rng.uniform(0, 8)
        for yr in range(1995, 2010):
            age = yr + 0.62 - t0
            if age > 0.6:
                rows.append((pid, f"c{yr % 100:02d}", age, 3 * math.exp(-age / 8) + rng.normal(0, 0.05)))
    return pd.DataFrame(rows, columns=["pid", "epoch", "age", "y"])


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    g = rng.choice(["a", "b", "c"], 4000, p=[0.7, 0.299, 0.001])
    v = np.where(rng.random(4000) < 0.33, 1.5, rng.normal(size=4000).round(3))  # one value holds a third of the rows
    pdf = pd.DataFrame({"g": g, "v": v})
    probs = [0.0, 0.025, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(pdf)
    got = qt.exact_quantiles(df, ["g"], "v", probs, list("abcde"), count="n").toPandas().set_index("g")
    for key, part in pdf.groupby("g"):
        assert got.loc[key, "n"] == len(part)
        np.testing.assert_allclose(got.loc[key, list("abcde")].astype(float), np.quantile(part.v, probs), atol=1e-12)
    whole = qt.exact_quantiles(df, [], "v", probs, list("abcde")).toPandas()
    np.testing.assert_allclose(whole.iloc[0].astype(float), np.quantile(pdf.v, probs), atol=1e-12)
    small = qt.small_quantiles(df, ["g"], "v", probs, list("abcde"), count="n").toPandas().set_index("g")
    np.testing.assert_allclose(small.loc[got.index, list("abcde")].astype(float), got[list("abcde")].astype(float), atol=1e-12)
    assert qt.exact_quantiles(df, ["g"], "v", probs, list("abcde"), min_n=100).count() == 2


def test_quantiles_of_a_wide_group(spark):
    df = spark.range(1_000_000).select(((F.col("id") * 611953) % 1_000_003 / 7).alias("v"))
    got = qt.exact_quantiles(df, [], "v", [0.1, 0.5, 0.999], list("abc")).first()
    np.testing.assert_allclose(list(got), np.quantile(df.toPandas().v, [0.1, 0.5, 0.999]))


def test_quantiles_where_each_derivation_of_the_sketch_cuts_elsewhere(spark, monkeypatch):
    """The parts of a sketch are merged in the order in which they arrive; here every merge moves the cuts by up to 300 ranks."""
    sketch = F.percentile_approx
    moved = lambda *a: F.sort_array(F.transform(sketch(*a), lambda x: x + F.reflect(F.lit("java.lang.Math"), F.lit("random")).cast("double") * 600))
    monkeypatch.setattr(qt.F, "percentile_approx", moved)
    df = spark.range(0, 40_000, 1, 4).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    probs = [i / 40 for i in range(41)]
    names = [f"q{i}" for i in range(41)]
    for keys in (["g"], []):
        got = qt.exact_quantiles(df, keys, "v", probs, names).toPandas()
        for _, row in got.iterrows():
            want = np.arange(row.g, 40_000, 2) if keys else np.arange(40_000)
            np.testing.assert_allclose(row[names].astype(float), np.quantile(want, probs), atol=1e-9)
        assert len(got) == (2 if keys else 1)


def test_numbers_and_samples_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(i % 50, None if i % 3 == 0 else f"n{i % 7}") for i in range(2050)], "a int, b string")
    keys = df.distinct()
    got = rk.global_row_number(keys, ["a", "b"], "n").collect()
    assert sorted(r.n for r in got) == list(range(1, keys.count() + 1))
    tied = spark.createDataFrame([(i // 10, i) for i in range(500)], "k int, i int")
    assert rk.every_nth(tied, ["k"], 7).count() == 72


def test_unlisted_period_is_an_error(spark):
    from regrowth.operators import fixed_effects as fe
    from regrowth.operators import reshape as rs

    df = spark.createDataFrame([(1, "p1", 1.0, 2.0), (1, "p2", 2.0, 1.0), (1, "p9", 2.0, 3.0), (2, "p1", 1.0, 1.0)], "u int, p string, y double, x double")
    for plan in (fe.two_way(df, "u", "p", "y", "x", ["p1", "p2"]), fe.two_way_demean(df, "u", "p", ["y", "x"], ["p1", "p2"]), rs.long_to_wide(df, ["u"], "p", ["p1", "p2"], ["y"])):
        with pytest.raises(Exception, match="period not listed"):
            plan.collect()


def test_offset_fit_holds_the_bound(spark):
    from regrowth.operators import fitting as ft

    rows = [(g, 0.5 + i, amp * math.exp(-(0.5 + i) / 4) + off, 0.1, 50) for g, amp, off in (("in", 3.0, 0.5), ("out", 60.0, 1.0)) for i in range(12)]
    bins = spark.createDataFrame(rows, "g string, centre double, mean double, se double, n long")
    got = {r.g: r for r in ft.offset_fit(bins, ["g"]).collect()}
    assert got["in"].amp == pytest.approx(3, abs=0.05) and not got["in"].on_bound
    assert got["out"].amp == pytest.approx(25) and got["out"].on_bound and abs(got["out"].offset) <= 10


def test_tolerance_sums_and_gradient_tiles(spark):
    from regrowth.operators import matching as mt
    from regrowth.operators import spatial as sp

    rng = np.random.default_rng(5)
    a = pd.DataFrame({"i": range(60), "k": rng.integers(0, 3, 60), "v": rng.uniform(-900, 900, 60).round(2)})
    b = pd.DataFrame({"k": rng.integers(0, 3, 400), "w": np.append(rng.uniform(-900, 900, 399).round(2), a.v[0] + 100)})
    got = {r.i: (r.n, round(r.total, 4)) for r in mt.tolerance_sums(spark.createDataFrame(a), spark.createDataFrame(b), ["k"], "i", "v", "w", 100.0).collect()}
    for r in a.itertuples():
        near = b[(b.k == r.k) & ((b.w - r.v).abs() <= 100)]
        assert got.get(r.i, (0, 0.0)) == (len(near), round(float(near.w.sum()), 4))
    grid = pd.DataFrame([(r, c, math.sin(r / 3) * c) for r in range(4) for c in range(600) if (r, c) != (1, 300)], columns=["row", "col", "z"])
    out = sp.terrain_gradient(spark.createDataFrame(grid), "z", 30.0).toPandas()
    assert len(out) == len(grid)
    z = {(r.row, r.col): r.z for r in grid.itertuples()}
    for r in out.sample(300, random_state=1).itertuples():
        def d(da, db):
            lo, hi = z.get((r.row - da, r.col - db)), z.get((r.row + da, r.col + db))
            return ((hi - lo) / 2 if lo is not None and hi is not None else hi - r.z if hi is not None else r.z - lo if lo is not None else math.nan) / 30
        assert r.slope_deg == pytest.approx(math.degrees(math.atan(math.hypot(d(0, 1), d(1, 0)))))


def test_global_row_number_and_samples(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k"))
    got = rk.global_row_number(df, ["k"], "n").toPandas().sort_values("k")
    assert list(got.n) == list(range(1, 1001))
    assert rk.every_nth(df, ["k"], 7).count() == 143
    assert rk.exact_sample(df, "k", 137, "s").count() == 137
    assert rk.exact_sample(df.limit(20), "k", 137, "s").count() == 20
    ranks = rk.hashed_rank(df, "k", "r", "t").toPandas()
    assert sorted(ranks.r) == list(range(1000)) and set(ranks.t) == {1000}


def test_top_k_ties(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 4), ("b", 9, 1)], "g string, id int, v int")
    got = rk.top_k_per_group(df, ["g"], [F.desc("v"), F.col("id")], 1).collect()
    assert sorted((r.g, r.id) for r in got) == [("a", 1), ("b", 9)]


def test_surrogate_key_groups(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("w", 2), (None, 3)], "e string, y int")
    got = sorted((r.e, r.gid) for r in rs.surrogate_key(df, ["e", "y"]).collect())
    assert got == [("w", 1), ("x", 2), ("x", 2)]


def test_fit_recovers_exact_curve(spark):
    t = np.arange(1.1, 20, 1.0)
    pdf = pd.DataFrame({"g": "e", "centre": t, "mean": 3 * np.exp(-t / 8), "se": 0.1, "n": 50})
    grow = pd.DataFrame({"g": "up", "centre": t, "mean": 1 + 0.1 * t, "se": 0.1, "n": 50})
    got = ft.fit_bins(spark.createDataFrame(pd.concat([pdf, grow])), ["g"]).toPandas().set_index("g")
    assert abs(got.loc["e", "tau"] - 8) < 1e-3 and abs(got.loc["e", "amp"] - 3) < 1e-3
    assert not got.loc["e", "at_bound"] and got.loc["up", "at_bound"] and abs(got.loc["up", "tau"] - 60) < 1e-6
    e = np.exp(-t / got.loc["e", "tau"])
    jac = np.column_stack([e, got.loc["e", "amp"] * e * t / got.loc["e", "tau"] ** 2]) / 0.1
    se = np.sqrt(np.diag(np.linalg.inv(jac.T @ jac)))
    np.testing.assert_allclose([got.loc["e", "amp_se"], got.loc["e", "tau_se"]], se, rtol=1e-6)


def test_fit_gates(spark):
    t = np.arange(1.1, 5.2, 1.0)
    pdf = pd.DataFrame({"g": "a", "centre": t, "mean": 2 * np.exp(-t / 5), "se": 0.1, "n": [10, 10, 10, 10, 9]})
    assert ft.fit_bins(spark.createDataFrame(pdf), ["g"]).count() == 0
    assert ft.fit_bins(spark.createDataFrame(pdf.assign(n=10)), ["g"]).count() == 1


def test_forms_rank_the_true_one_first(spark):
    t = np.arange(1.1, 22, 1.0)
    pdf = pd.DataFrame({"case": "x", "centre": t, "mean": 2 * np.exp(-t / 4) + 0.7, "se": 0.01, "n": 40})
    got = ft.compare_forms(spark.createDataFrame(pdf), "case").toPandas().set_index("form")
    assert got.aicc.idxmin() == "exponential+offset"
    assert bool(got.loc["exponential+offset", "offset_nonzero"])
    assert abs(got.loc["exponential+offset", "params"][2] - 0.7) < 1e-3
    line = np.polyfit(t, pdf["mean"], 1)
    np.testing.assert_allclose(got.loc["linear", "params"], line[::-1], rtol=1e-6)


def test_bootstrap_weights_and_moments(spark, panel):
    df = spark.createDataFrame(panel.assign(bin=np.floor(panel.age - 0.6).astype(int)))
    units = df.select("pid").distinct()
    w = bt.replicate_weights(units, "pid", 25, "t").toPandas()
    assert set(w.groupby("rep").w.sum()) == {60}
    again = bt.replicate_weights(units.repartition(3), "pid", 25, "t").toPandas()
    key = ["pid", "rep"]
    pd.testing.assert_frame_equal(w.sort_values(key).reset_index(drop=True), again.sort_values(key).reset_index(drop=True))
    p = bt.replicate_weights(units, "pid", 200, "t", "poisson").toPandas()
    assert abs(p.w.sum() / (60 * 200) - 1) < 0.05
    cells = bt.weighted_cells(bt.unit_sums(df, "pid", ["bin"], "y"), spark.createDataFrame(w), "pid", ["bin"]).toPandas()
    rep = cells[(cells.rep == 7) & (cells.bin == 6)].iloc[0]
    m = panel.assign(bin=np.floor(panel.age - 0.6).astype(int)).merge(w[w.rep == 7], on="pid")
    rows = m.loc[m.index.repeat(m.w)]
    rows = rows[rows.bin == 6].y
    assert rep.n == len(rows)
    np.testing.assert_allclose([rep["mean"], rep.se], [rows.mean(), rows.std() / math.sqrt(len(rows))], rtol=1e-9)


def test_fixed_effects_match_least_squares(spark, panel):
    df = spark.createDataFrame(panel).withColumn("shape", F.exp(-F.col("age") / 8))
    kept = fe.long_enough(df, "pid")
    got = fe.two_way(kept, "pid", "epoch", "y", "shape", sorted(panel.epoch.unique())).toPandas().iloc[0]
    d = panel.assign(g=np.exp(-panel.age / 8))
    units = pd.get_dummies(d.pid).to_numpy(float)
    periods = pd.get_dummies(d.epoch).to_numpy(float)[:, 1:]
    one = np.linalg.lstsq(np.column_stack([units, d.g]), d.y, rcond=None)[0][-1]
    two = np.linalg.lstsq(np.column_stack([units, periods, d.g]), d.y, rcond=None)[0][-1]
    np.testing.assert_allclose([got.beta_unit, got.beta_two_way], [one, two], rtol=1e-7)
    swept = fe.two_way_demean(kept, "pid", "epoch", ["y", "shape"], sorted(panel.epoch.unique())).toPandas()
    both = np.column_stack([units, periods])
    res = d.y - both @ np.linalg.lstsq(both, d.y, rcond=None)[0]
    np.testing.assert_allclose(np.sort(swept.y_tw), np.sort(res), atol=1e-9)
    demeaned = fe.within_demean(kept, "pid", ["y"]).groupBy("pid").agg(F.avg("y_w").alias("m")).agg(F.max(F.abs("m"))).first()[0]
    assert demeaned < 1e-12


def test_tau_grid(spark, panel):
    best = fe.tau_by_grid(spark.createDataFrame(panel), "pid", "y", "age").toPandas().iloc[0]
    grid = np.arange(1.0, 60.01, 0.25)

    def ssr(tau):
        w = np.exp(-panel.age / tau)
        d = panel.assign(yw=panel.y * w, ww=w * w, yy=panel.y**2).groupby("pid")[["yw", "ww", "yy"]].sum()
        return float((d.yy - d.yw**2 / d.ww).sum())

    assert best.tau_fe == grid[int(np.argmin([ssr(t) for t in grid]))]


def test_history_rule_edges(spark):
    rows = [(1, 1.0), (1, 2.0), (1, 3.0)] + [(2, a) for a in (0.0, 1.0, 2.0, 3.9)] + [(3, a) for a in (0.0, 1.0, 2.0, 4.0)]
    kept = fe.long_enough(spark.createDataFrame(rows, "pid int, age double"), "pid")
    assert {r.pid for r in kept.collect()} == {3}


def test_grouped_residuals(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 600), "a": rng.normal(size=600), "b": rng.normal(1e4, 5, 600)})
    pdf["y"] = pdf.g + 2 * pdf.a - 0.3 * pdf.b + rng.normal(size=600)
    got = rg.residuals(spark.createDataFrame(pdf), ["g"], "y", ["a", "b"]).toPandas()
    for g, part in pdf.groupby("g"):
        x = np.column_stack([part.a, part.b, np.ones(len(part))])
        res = part.y - x @ np.linalg.lstsq(x, part.y, rcond=None)[0]
        np.testing.assert_allclose(np.sort(got[got.g == g].res), np.sort(res), atol=1e-6)


def test_small_math(spark):
    df = spark.createDataFrame([([4.0, 1.0, 1.0, 3.0], [1.0, 2.0]), ([1.0, 1.0, 1.0, 1.0], [1.0, 1.0])], "m array<double>, b array<double>")
    got = [r[0] for r in df.select(solve_normal("m", "b")).collect()]
    np.testing.assert_allclose(got[0], np.linalg.solve([[4, 1], [1, 3]], [1, 2]))
    np.testing.assert_allclose(got[1], [0.5, 0.5])  # redundant columns
    tails = spark.createDataFrame([(12.592, 6), (3.841, 1), (7.815, 3)], "x double, k int").select(chi2_tail("x", "k")).collect()
    np.testing.assert_allclose([r[0] for r in tails], [0.05] * 3, atol=2e-4)
    p = spark.createDataFrame([(2.228, 10.0), (1.96, 1e6)], "t double, df double").select(t_two_sided("t", "df")).collect()
    np.testing.assert_allclose([r[0] for r in p], [0.05, 0.05], atol=2e-4)


def test_numeric_gradient_matches_numpy(spark):
    x = np.array([1.0, 2.0, 4.0, 5.0, 9.0])
    y = x**2 + 1
    got = rg.numeric_gradient(spark.createDataFrame(pd.DataFrame({"k": 1, "x": x, "y": y})), ["k"], "x", "y").orderBy("x").toPandas()
    np.testing.assert_allclose(got.gradient, np.gradient(y, x))
    at = [0.0, 1.5, 4.0, 20.0]
    v = rg.interpolate(spark.createDataFrame(pd.DataFrame({"k": 1, "x": x, "y": y})), ["k"], "x", "y", at).orderBy("x_at").toPandas()
    np.testing.assert_allclose(v.value, np.interp(at, x, y))


def test_pretrend_terms(spark):
    pts = spark.createDataFrame([(-4, 0.3), (-3, 0.1), (-2, 0.2), (1, 2.0), (2, 1.8)], "k long, beta double")
    t = es.pretrend_terms(pts, []).toPandas().iloc[0]
    x, b = np.array([-3.0, -2.0, -1.0]), np.array([0.3, 0.1, 0.2])
    assert abs(t.slope_ref - (x @ b) / (x @ x)) < 1e-12 and abs(t.slope_free - np.polyfit(x, b, 1)[0]) < 1e-12
    assert abs(t.max_step - 0.2) < 1e-12 and t.k1 == 1 and abs(t.adjusted_ref - (2.0 - t.slope_ref * 2)) < 1e-12


def brute_components(cells):
    left, out = set(cells), []
    while left:
        todo, comp = [left.pop()], set()
        while todo:
            r, c = todo.pop()
            comp.add((r, c))
            for dr, dc in itertools.product((-1, 0, 1), repeat=2):
                if (r + dr, c + dc) in left:
                    left.remove((r + dr, c + dc))
                    todo.append((r + dr, c + dc))
        out.append(frozenset(comp))
    return set(out)


def test_connected_components(spark):
    rng = np.random.default_rng(9)
    cells = {(int(r), int(c)) for r, c in zip(*np.nonzero(rng.random((40, 40)) < 0.42))}
    ring = {(60, c) for c in range(60, 70)} | {(69, c) for c in range(60, 70)} | {(r, 60) for r in range(60, 70)} | {(r, 69) for r in range(60, 70)}
    cells |= ring | {(100, 100), (101, 101)}
    got = sp.connected_components(spark.createDataFrame(sorted(cells), "row long, col long"), min_px=1).toPandas()
    parts = {frozenset(zip(g.row, g.col)) for _, g in got.groupby("label")}
    assert parts == brute_components(cells)


def test_candidate_controls_distance(spark):
    rng = np.random.default_rng(2)
    grid = pd.DataFrame([(r, c) for r in range(70) for c in range(70)], columns=["row", "col"])
    grid["elev"], grid["slope"] = 1000 + rng.uniform(-300, 300, len(grid)), rng.uniform(0, 30, len(grid))
    own = {(30, 30), (30, 31), (31, 30), (35, 40)}
    is_own = [(r, c) in own for r, c in zip(grid.row, grid.col)]
    u = spark.createDataFrame(grid[is_own][["row", "col"]].assign(unit=1))
    layers = spark.createDataFrame(grid)
    prof = sp.unit_profile(u, layers, "unit", ["elev", "slope"])
    got = sp.candidate_controls(u, prof, spark.createDataFrame(grid[~np.array(is_own)]), "unit", reach=20).toPandas()
    o = grid[is_own]
    rest = grid[~np.array(is_own)].copy()
    rest["d2"] = np.min([(rest.row - r) ** 2 + (rest.col - c) ** 2 for r, c in own], axis=0)
    want = rest[(rest.d2 <= 400) & ((rest.elev - o.elev.mean()).abs() <= 250) & ((rest.slope - o.slope.mean()).abs() <= 15)]
    m = got.merge(want, on=["row", "col"], suffixes=("", "_w"))
    assert len(got) == len(want) == len(m) and (m.d2 == m.d2_w).all()


def test_wide_to_long_and_drift(spark):
    wide = spark.createDataFrame([(1, 1996.5, "c95", 1.0, None, None), (2, 1990.0, "", None, 2.0, 0.5)], "pid int, t_event double, pre_tag string, dlst_c95 double, dlst_c97 double, dndvi_c97 double")
    got = {(r.pid, r.epoch): r for r in rs.wide_to_long(wide, ["pid"], {"c95": 1995.62, "c96": 1996.62, "c97": 1997.62}).collect()}
    assert set(got) == {(1, "c95"), (2, "c97")}
    assert got[(1, "c95")].is_pre and got[(1, "c95")].dndvi is None and got[(2, "c97")].dndvi == 0.5


def test_strata_and_support(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, None)], "id int, x double")
    rows = bn.strata_rows(df, [("all", F.lit(True)), ("low", F.col("x") < 1)])
    assert sorted((r.id, r.stratum) for r in rows.collect()) == [(1, "all"), (1, "low"), (2, "all"), (3, "all")]


def test_merge_replace_fingerprint(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    new = spark.createDataFrame([("b", 5), ("c", 6)], "key string, value int")
    assert sorted(map(tuple, tb.merge_results(old, new, ["key"]).collect())) == [("a", 1), ("b", 5), ("c", 6)]
    a = tb.fingerprint(old, "t").first()
    assert a == tb.fingerprint(old.orderBy(F.desc("key")).repartition(3), "t").first()
    assert a.checksum != tb.fingerprint(new, "t").first().checksum
    one, two = (tb.fingerprint(old.unionAll(spark.createDataFrame([x, x], old.schema)), "t").first() for x in (("c", 1), ("d", 4)))
    assert one.checksum == two.checksum and one.total != two.total  # equal rows cancel in one and not in the other


def test_result_diff_tolerance(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", float("nan")), ("z", 3.0), ("gone", 1.0)], "key string, value double")
    b = spark.createDataFrame([("x", 1.0 + 1e-12), ("y", None), ("z", 3.1), ("new", 1.0)], "key string, value double")
    got = {r.key: r.status for r in vf.result_diff(a, b, "key", "value").collect()}
    assert got == {"z": "changed", "gone": "missing", "new": "added"}


def test_hot_unit_keeps_results_whole(spark):
    """One unit with a third of all rows: means, top-k, samples and replicates still cover every row."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"pid": np.where(rng.random(3000) < 0.34, 7, rng.integers(100, 160, 3000)), "y": rng.normal(5, 1, 3000)})
    pdf["id"] = np.arange(3000)
    df = spark.createDataFrame(pdf)
    got = fe.within_demean(df, "pid", ["y"]).toPandas()
    assert len(got) == 3000
    np.testing.assert_allclose(got.sort_values("id").y_w, pdf.y - pdf.groupby("pid").y.transform("mean"), atol=1e-12)
    top = rk.top_k_per_group(df, ["pid"], [F.desc("y"), F.col("id")], 40).groupBy("pid").count().toPandas().set_index("pid")["count"]
    want = pdf.groupby("pid").size().clip(upper=40)
    assert (top.sort_index() == want.sort_index()).all()
    sample = rk.sample_per_stratum(df, ["pid"], "id", 25, "s").groupBy("pid").count().toPandas().set_index("pid")["count"]
    assert (sample.sort_index() == pdf.groupby("pid").size().clip(upper=25).sort_index()).all()
    w = bt.replicate_weights(df.select("pid").distinct(), "pid", 10, "h")
    cells = bt.weighted_cells(bt.unit_sums(df, "pid", [], "y"), w, "pid", []).toPandas()
    assert len(cells) == 10 and cells.n.min() > 0


def test_streamed_sums_equal_batch(spark):
    from regrowth.streaming import accumulate as st

    rows = [(i, f"2024-01-{1 + i % 20:02d} 00:00:00", i % 5, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, t string, cell int, value double").select("id", F.to_timestamp("t").alias("ts"), "cell", "value")
    path, per_batch = st.stage_as_files(df, "ts", 5)
    stream = st.read_scene_stream(spark, path, df.schema, per_batch)
    doubled = stream.union(stream)  # every record arrives twice
    sums = st.running_sums(doubled, ["cell"], "value", id_column="id")
    got = st.latest_state(spark, st.run_to_table(sums, "test-sums"), ["cell"]).toPandas().set_index("cell").sort_index()
    want = df.groupBy("cell").agg(F.count("value").alias("n"), F.sum("value").alias("total")).toPandas().set_index("cell").sort_index()
    assert (got.n == want.n).all() and np.allclose(got.total, want.total)
