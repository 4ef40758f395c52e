import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regrowth.operators import sketches as sk
from regrowth.operators import spatial as sp
from regrowth.plans.catalogue import QUERIES
from regrowth.session import new_work_path
from regrowth.sources import tables as tb


def test_distinct_sketches_merge(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("part"), (F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(9000)).alias("v"))
    parts = sk.distinct_parts(rows, ["g", "part"], "v")
    late = sk.distinct_parts(rows.where("v < 10").select(F.lit(9).alias("part"), "g", "v"), ["g", "part"], "v")  # adds nothing new
    exact = dict(rows.groupBy("g").agg(F.count_distinct("v")).collect())
    for got in (sk.merged_distinct(parts, ["g"]), sk.merged_distinct(parts.unionByName(late), ["g"])):
        assert all(abs(r.n_distinct - exact[r.g]) <= exact[r.g] * sk.distinct_error() for r in got.collect())
    assert sk.merged_distinct(parts.limit(0), ["g"]).count() == 0
    only_null = spark.createDataFrame([(1, None)], "g int, v string")
    assert sk.merged_distinct(sk.distinct_parts(only_null, ["g"], "v"), ["g"]).first().n_distinct == 0


def test_quantile_sketches_merge(spark):
    rng = np.random.default_rng(1)
    d = pd.DataFrame({"p": rng.integers(0, 9, 30_000), "v": np.where(rng.random(30_000) < 0.3, 5.0, rng.gamma(2, 3, 30_000))})  # a third are ties
    parts = sk.quantile_parts(spark.createDataFrame(d), ["p"], "v")
    probs = [0.01, 0.25, 0.5, 0.9, 0.99]
    got = sk.merged_quantiles(parts.withColumn("one", F.lit(1)), ["one"], probs, [f"q{i}" for i in range(5)]).toPandas().iloc[0]
    for i, p in enumerate(probs):
        lo, hi = (d.v < got[f"q{i}"]).mean(), (d.v <= got[f"q{i}"]).mean()
        assert lo - sk.rank_error() <= p <= hi + sk.rank_error()


def test_large_box_adds_few_rows(spark):
    small = [(i, float(i % 40), float(i % 40) + 1.0, float(i // 40), float(i // 40) + 1.0) for i in range(400)]
    large = (1000, 0.0, 1000.0, -500.0, 500.0)
    boxes = spark.createDataFrame([*small, large], "b int, west double, east double, south double, north double")
    tiles = sp.tiled_boxes(boxes, "west", "east", "south", "north", 1.0)
    assert tiles.where("b = 1000").count() <= 4 and tiles.count() <= 4 * 401
    rng = np.random.default_rng(2)
    pts = pd.DataFrame({"id": range(500), "x": rng.uniform(-5, 60, 500), "y": rng.uniform(-5, 15, 500)})
    pts.loc[:50, ["x", "y"]] = np.floor(pts.loc[:50, ["x", "y"]])  # on the borders
    got = {(r.id, r.b) for r in sp.points_in_boxes(spark.createDataFrame(pts), boxes, "x", "y", 1.0).collect()}
    want = {(p.id, b) for p in pts.itertuples() for b, w, e, s, n in [*small, large] if w <= p.x < e and s <= p.y < n}
    assert got == want
    assert sp.points_in_boxes(spark.createDataFrame(pts), boxes.limit(0), "x", "y", 1.0).count() == 0


def test_footprints_of_any_size(spark):
    rng = np.random.default_rng(3)
    sizes = [1, 7, 60, 5000]
    feet = [(k, int(r), int(c), int(r) + s, int(c) + s) for k, (s, r, c) in enumerate(zip(sizes * 20, rng.integers(-50, 200, 80), rng.integers(-50, 200, 80)))]
    win = [(k, int(r), int(c), int(r) + int(h), int(c) + int(w)) for k, (r, c, h, w) in enumerate(zip(*rng.integers(1, 200, (2, 150)), *rng.integers(1, 9, (2, 150))))]
    got = sp.windows_in_footprints(
        spark.createDataFrame(win, "w int, r0 int, c0 int, r1 int, c1 int"), spark.createDataFrame(feet, "f int, fr0 int, fc0 int, fr1 int, fc1 int"), 10)
    want = {(w, f) for w, r0, c0, r1, c1 in win for f, a, b, c, d in feet if r0 >= a and c0 >= b and r1 <= c and c1 <= d}
    assert {(r.w, r.f) for r in got.collect()} == want and want


def test_unit_minus_control_by_period_vectors(spark):
    rng = np.random.default_rng(4)
    cells = [(r, c) for r in range(12) for c in range(12)]
    own = [(u, r, c) for u in (1, 2) for r, c in cells if (r < 3) == (u == 1) and c < 4]
    ctl = [(u, r, c) for u in (1, 2) for r, c in cells if c >= 5]
    obs = [(r, c, p, float(rng.normal())) for r, c in cells for p in ("a", "b", "x") if rng.random() < (0.9 if p != "x" else 0.05)]
    frame = lambda rows, cols: spark.createDataFrame(rows, cols)
    got = sp.unit_minus_control(frame(own, "u int, row int, col int"), frame(ctl, "u int, row int, col int"), frame(obs, "row int, col int, p string, v double"), "u", "p", "v").toPandas()
    o = pd.DataFrame(obs, columns=["row", "col", "p", "v"])
    want = {}
    for u in (1, 2):
        for p in ("a", "b", "x"):
            pick = lambda rows: pd.DataFrame([x[1:] for x in rows if x[0] == u], columns=["row", "col"]).merge(o[o.p == p]).v  # noqa: E731, B023
            a, b = pick(own), pick(ctl)
            if len(a) >= max(3, 0.3 * sum(x[0] == u for x in own)) and len(b) >= 20:
                want[u, p] = (len(a), len(b), a.mean() - b.mean())
    assert {(r.u, r.p) for r in got.itertuples()} == set(want) and len(want) >= 4
    for r in got.itertuples():
        np.testing.assert_allclose([r.n_unit, r.n_ctrl, r.delta], want[r.u, r.p])
    empty = sp.unit_minus_control(frame(own, "u int, row int, col int"), frame(ctl, "u int, row int, col int"), frame([], "row int, col int, p string, v double"), "u", "p", "v")
    assert empty.count() == 0


def test_slices_are_replaced_in_place(spark):
    path = new_work_path(spark, "slices")
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "s string, v int")
    tb.write_table(old, path, ["s"])
    read = lambda: sorted((str(r.s), r.v) for r in spark.read.parquet(path).collect())
    fresh = spark.createDataFrame([("a", 9), ("c", 7)], "s string, v int")
    for _ in range(2):  # a repeated write changes nothing more
        tb.replace_partitions(fresh, path, ["s"])
        assert read() == [("None", 4), ("a", 9), ("b", 3), ("c", 7)]
    broken = spark.createDataFrame([("b", 1), ("b", 0)], "s string, v int").select("s", F.when(F.col("v") == 0, F.raise_error("stop").cast("int")).otherwise(F.col("v")).alias("v"))
    with pytest.raises(Exception, match="stop"):
        tb.replace_partitions(broken, path, ["s"])
    assert read() == [("None", 4), ("a", 9), ("b", 3), ("c", 7)]


def test_pairs_of_the_control_search_are_not_written(spark, monkeypatch):
    """Only cells are written; pairs of unit and cell are summed where they are found."""
    written, real = [], sp.materialise
    monkeypatch.setattr(sp, "materialise", lambda df, name, path=None: written.append(name) or real(df, name, path))
    for name in ("tiered_match", "unit_minus_control"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "candidates" not in written and "period-cells" in written
