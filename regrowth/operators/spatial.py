"""Operators on pixel tables keyed by (row, col): components, profiles, masks, neighbours and block averages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from regrowth.session import discard, materialise, new_work_path

TILE = 16  # cells per side of a join tile
LINE = 256  # cells of a line's tile


def row_runs(px: DataFrame, keys: list[str]) -> DataFrame:
    """Horizontal runs (keys, row, c0, c1) of consecutive cells; a grid row bounds each window."""
    pos = F.col("col") - F.row_number().over(W.partitionBy(*keys, "row").orderBy("col"))
    return px.select(*keys, "row", "col").distinct().withColumn("_g", pos).groupBy(*keys, "row", "_g").agg(
        F.min("col").alias("c0"), F.max("col").alias("c1")
    ).drop("_g")


def connected_components(px: DataFrame, min_px: int = 10) -> DataFrame:
    """Label 8-connected cells with the smallest pixel id of their component; components below ``min_px`` drop out.

    Cells are first merged into horizontal runs, which are linked to runs of the next row. The links then shrink
    by alternating large-star and small-star steps, each written to the shared folder.
    """
    runs = row_runs(px, []).withColumn("run", F.col("row") * F.lit(1 << 31) + F.col("c0"))
    runs = materialise(runs, "runs")
    below = runs.select((F.col("row") - 1).alias("row"), F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("run").alias("other"))
    # runs of one row do not overlap, so a run meets few runs of the next row; tiles keep the join local
    width = 64
    tile = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
    left = runs.withColumn("_t", tile(F.col("c0") - 1, F.col("c1") + 1))
    right = below.withColumn("_t", tile(F.col("d0"), F.col("d1")))
    edges = (
        left.join(right, ["row", "_t"])
        .where((F.col("d0") <= F.col("c1") + 1) & (F.col("d1") >= F.col("c0") - 1))
        .select(F.greatest("run", "other").alias("u"), F.least("run", "other").alias("v"))
        .distinct()
    )
    spark, path = px.sparkSession, new_work_path(px.sparkSession, "links")
    edges = materialise(edges, "links", path)
    state, before = _edge_state(edges), None
    while state != before:
        old, path = path, new_work_path(spark, "links")
        edges = materialise(_small_star(_large_star(edges)), "links", path)
        discard(spark, old)  # the round before is not read again
        state, before = _edge_state(edges), state
    labels = edges.groupBy("u").agg(F.min("v").alias("label"))
    tagged = runs.join(labels, runs["run"] == labels["u"], "left").withColumn("label", F.coalesce("label", "run"))
    sizes = tagged.groupBy("label").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("_n")).where(F.col("_n") >= min_px)
    kept = tagged.join(sizes, "label", "left_semi")
    return kept.select("label", "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def _edge_state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(r)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node it can see."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u <> v").distinct()


def component_summary(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_px"),
        F.min("row").alias("r0"), F.min("col").alias("c0"), (F.max("row") + 1).alias("r1"), (F.max("col") + 1).alias("c1"),
        F.avg("row").alias("row_mean"), F.avg("col").alias("col_mean"),
    )


def unit_profile(unit_px: DataFrame, layers: DataFrame, unit: str, values: list[str]) -> DataFrame:
    """Mean of each layer over the cells of a unit."""
    return unit_px.join(layers, ["row", "col"]).groupBy(unit).agg(
        F.count(F.lit(1)).alias("n_px"), *[F.avg(v).alias(f"{v}_mean") for v in values]
    )


def candidate_controls(unit_px: DataFrame, profile: DataFrame, intact: DataFrame, unit: str, reach: int = 50, d_elev: float = 250.0, d_slope: float = 15.0, carry: list[str] | None = None) -> DataFrame:
    """Intact cells within ``reach`` of a unit inside the wide elevation and slope bands, with the squared distance.

    A unit is described by its row runs, which are copied to the tiles they can reach; intact cells sit in one tile. The nearest run
    of a (unit, cell) pair is picked where its tile is, so pairs are never shuffled. A tile holds at most TILE*TILE
    cells, so no key can grow with the data. ``carry`` names more columns of ``intact`` to hand on.
    """
    runs = row_runs(unit_px, [unit]).join(profile.select(unit, "elev_mean", "slope_mean"), unit)
    span = lambda lo, hi: F.explode(F.sequence(F.floor((lo - reach) / TILE), F.floor((hi + reach) / TILE)))
    tiled = runs.withColumn("_tr", span(F.col("row"), F.col("row"))).withColumn("_tc", span(F.col("c0"), F.col("c1")))
    # drop tiles whose nearest corner is already too far
    far_r = F.greatest(F.lit(0), F.col("_tr") * TILE - F.col("row"), F.col("row") - F.col("_tr") * TILE - (TILE - 1))
    far_c = F.greatest(F.lit(0), F.col("_tc") * TILE - F.col("c1"), F.col("c0") - F.col("_tc") * TILE - (TILE - 1))
    tiled = tiled.where(far_r * far_r + far_c * far_c <= reach * reach).withColumnRenamed("row", "_row")
    cells = intact.select("row", "col", "elev", "slope", *(carry or [])).withColumns(
        {"_tr": F.floor(F.col("row") / TILE), "_tc": F.floor(F.col("col") / TILE)}
    )
    # few bytes meet here and many pairs leave: the number of tasks must not follow the bytes
    cells = cells.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_tr", "_tc")

    dc = F.greatest(F.lit(0), F.col("c0") - F.col("col"), F.col("col") - F.col("c1"))
    dr = F.col("row") - F.col("_row")
    elev, slope = F.abs(F.col("elev") - F.col("elev_mean")), F.abs(F.col("slope") - F.col("slope_mean"))
    pairs = cells.join(tiled, ["_tr", "_tc"]).withColumn("d2", dr * dr + dc * dc).where((elev <= d_elev) & (slope <= d_slope) & (F.col("d2") <= reach * reach))
    # keyed by the tile too: the rows lie by tile already, so this aggregate needs no exchange
    nearest = pairs.groupBy("_tr", "_tc", unit, "row", "col").agg(
        F.min("d2").alias("d2"), F.first(elev).alias("d_elev"), F.first(slope).alias("d_slope"), *[F.first(c).alias(c) for c in carry or []]
    )
    return nearest.drop("_tr", "_tc")


CLOSE = "d2 BETWEEN 16 AND 900 AND d_elev <= 150 AND d_slope <= 10"


def tiered_sums(candidates: DataFrame, unit: str, sums: list[str], least: int = 30) -> DataFrame:
    """Per unit: number of close controls, of those chosen by ``tiered_controls``, and sums of columns over the chosen ones.

    Both tiers are summed in one pass over the candidates, in each task, and the choice is made between sums.
    """
    close = F.expr(CLOSE)
    g = candidates.where(F.col("d2") >= 16).groupBy(unit).agg(
        F.count_if(close).alias("n_tier1"), F.count(F.lit(1)).alias("_n"),
        *[f for c in sums for f in (F.sum(F.when(close, F.col(c))).alias(f"_close_{c}"), F.sum(c).alias(f"_wide_{c}"))],
    )
    enough = F.col("n_tier1") >= least
    chosen = [F.when(enough, F.col(f"_close_{c}")).otherwise(F.col(f"_wide_{c}")).alias(c) for c in sums]
    return g.select(unit, "n_tier1", F.when(enough, F.col("n_tier1")).otherwise(F.col("_n")).alias("n_ctrl"), *chosen)


def tiered_controls(candidates: DataFrame, unit: str, least: int = 30) -> DataFrame:
    """Close controls where a unit has ``least`` of them, else the wide ones. The candidates are written once: the counts and the
    choice both read them, and finding them is the dear part."""
    close = F.expr(CLOSE)
    far = materialise(candidates.where(F.col("d2") >= 16).withColumn("tier1", close), "candidates")
    n1 = far.groupBy(unit).agg(F.count_if("tier1").alias("n_tier1"))
    return far.join(n1, unit).where(F.col("tier1") | (F.col("n_tier1") < least))


def unit_minus_control(unit_px: DataFrame, controls: DataFrame, obs: DataFrame, unit: str, period: str, value: str, periods: list | None = None) -> DataFrame:
    """Mean over unit cells minus mean over control cells, for every period observed.

    Needs max(3, 0.3 * cells) unit values and 20 control values. A cell is one row with a count and a sum for every period, so a
    (unit, cell) pair is one row whatever the number of periods, and pairs are summed by unit before they are shuffled. The few
    periods are read from ``obs`` unless given; observations of other periods are not used then.
    """
    periods, cells = _period_cells(obs, period, value, periods)
    each = lambda make: [c for i, p in enumerate(periods) for c in make(i, p)]
    roles = unit_px.select(unit, "row", "col", F.lit(True).alias("_own")).unionByName(controls.select(unit, "row", "col", F.lit(False).alias("_own")))
    # one sum per period and role over the pairs; the two roles of a unit then stand side by side
    summed = roles.join(cells, ["row", "col"]).groupBy(unit, "_own").agg(F.count(F.lit(1)).alias("_pairs"), *each(lambda i, p: (F.sum(f"_n{i}").alias(f"_n{i}"), F.sum(f"_s{i}").alias(f"_s{i}"))))
    pick = lambda c, own: F.max(F.when(F.col("_own") == own, F.col(c)))
    side = lambda i, p: (pick(f"_n{i}", True).alias(f"_un{i}"), pick(f"_s{i}", True).alias(f"_us{i}"), pick(f"_n{i}", False).alias(f"_cn{i}"), pick(f"_s{i}", False).alias(f"_cs{i}"))
    sums = summed.groupBy(unit).agg(F.sum("_pairs").alias("_pairs"), *each(side))
    return _unit_minus(sums, unit_px, unit, period, periods)


def unit_minus_tiered(unit_px: DataFrame, profile: DataFrame, intact: DataFrame, obs: DataFrame, unit: str, period: str, value: str, periods: list | None = None) -> DataFrame:
    """``unit_minus_control`` against the controls of ``tiered_controls``: the cells carry their observations into the search, and
    its pairs are summed where they are found, so that none is shuffled or written."""
    periods, cells = _period_cells(obs, period, value, periods)
    cells = materialise(cells, "period-cells")
    names = [f"{c}{i}" for i in range(len(periods)) for c in ("_n", "_s")]
    seen = intact.join(cells.drop("_all"), ["row", "col"], "left")
    control = tiered_sums(candidate_controls(unit_px, profile, seen, unit, carry=names), unit, names)
    own = unit_px.select(unit, "row", "col").join(cells, ["row", "col"]).groupBy(unit).agg(*[F.sum(c).alias(f"_u{c[1:]}") for c in names])
    control = control.select(unit, *[F.col(c).alias(f"_c{c[1:]}") for c in names])
    return _unit_minus(own.join(control, unit), unit_px, unit, period, periods)


def _period_cells(obs: DataFrame, period: str, value: str, periods: list | None) -> tuple[list, DataFrame]:
    """The periods, and a row per cell with count and sum of each."""
    if periods is None:
        periods = sorted(x[0] for x in obs.select(period).distinct().collect() if x[0] is not None)
    at = lambda p: F.when(F.col(period) == p, F.col(value))
    each = [c for i, p in enumerate(periods) for c in (F.count(at(p)).alias(f"_n{i}"), F.sum(at(p)).alias(f"_s{i}"))]
    return periods, obs.where(F.col(period).isin(periods)).groupBy("row", "col").agg(F.count(F.lit(1)).alias("_all"), *each)


def _unit_minus(sums: DataFrame, unit_px: DataFrame, unit: str, period: str, periods: list) -> DataFrame:
    """Rows by unit and period from counts and sums of both roles; too few values leave a row out."""
    one = [
        F.struct(F.lit(p).alias(period), F.coalesce(f"_un{i}", F.lit(0)).alias("n_unit"), F.coalesce(f"_cn{i}", F.lit(0)).alias("n_ctrl"),
                 (F.col(f"_us{i}") / F.col(f"_un{i}") - F.col(f"_cs{i}") / F.col(f"_cn{i}")).alias("delta"))
        for i, p in enumerate(periods)
    ]
    n_px = unit_px.groupBy(unit).agg(F.count(F.lit(1)).alias("_n_px"))
    enough = (F.col("n_unit") >= F.greatest(F.lit(3.0), 0.3 * F.col("_n_px"))) & (F.col("n_ctrl") >= 20)
    if not one:
        return sums.join(n_px, unit).select(unit, F.lit(None).alias(period), F.lit(0).alias("n_unit"), F.lit(0).alias("n_ctrl"), F.lit(None).cast("double").alias("delta")).limit(0)
    return sums.join(n_px, unit).select(unit, "_n_px", F.inline(F.array(*one))).where(enough).drop("_n_px")


def level_of(span, cell: float):
    """The level whose tiles, ``cell * 2**level`` wide, are at least as wide as ``span``."""
    return F.greatest(F.lit(0), F.ceil(F.log2(span / F.lit(float(cell))))).cast("int")


def tiled_boxes(boxes: DataFrame, west: str, east: str, south: str, north: str, cell: float) -> DataFrame:
    """Boxes copied to the tiles of their own level that they touch: at most two by two, however large a box is."""
    wide = F.greatest(F.col(east) - F.col(west), F.col(north) - F.col(south))
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_level"))
    along = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    return boxes.withColumn("_level", F.when(wide > 0, level_of(wide, cell)).otherwise(0)).withColumn("_bx", along(west, east)).withColumn("_by", along(south, north))


def probing(points: DataFrame, tiles: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    """Points with the tile they lie in at every level that holds a box (levels double, so there are few)."""
    levels = tiles.agg(F.collect_set("_level")).scalar()
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_level"))
    return points.withColumn("_level", F.explode(levels)).withColumns({"_bx": F.floor(F.col(x) / size), "_by": F.floor(F.col(y) / size)})


def points_in_boxes(points: DataFrame, boxes: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    """Half-open box join west <= x < east, south <= y < north through tiles of several levels; ``cell`` is the smallest tile."""
    tiles = tiled_boxes(boxes, "west", "east", "south", "north", cell)
    hit = (F.col(x) >= F.col("west")) & (F.col(x) < F.col("east")) & (F.col(y) >= F.col("south")) & (F.col(y) < F.col("north"))
    return probing(points, tiles, x, y, cell).join(tiles, ["_level", "_bx", "_by"]).where(hit).drop("_level", "_bx", "_by")


def windows_in_footprints(windows: DataFrame, scenes: DataFrame, cell: int) -> DataFrame:
    """Windows (r0, c0, r1, c1) that lie fully inside a footprint (fr0, fc0, fr1, fc1), met at the window's corner."""
    tiles = tiled_boxes(scenes, "fc0", "fc1", "fr0", "fr1", cell)
    inside = (F.col("r0") >= F.col("fr0")) & (F.col("c0") >= F.col("fc0")) & (F.col("r1") <= F.col("fr1")) & (F.col("c1") <= F.col("fc1"))
    return probing(windows, tiles, "c0", "r0", cell).join(tiles, ["_level", "_bx", "_by"]).where(inside).drop("_level", "_bx", "_by")


def terrain_gradient(grid: DataFrame, value: str, size: float) -> DataFrame:
    """Slope (degrees), aspect components from neighbours; central differences, one-sided at gaps and edges.

    A line of cells is cut into tiles, and the cells at a tile's edges are lent to the next tile, so that no window grows with
    the grid in either direction.
    """
    out = grid
    for name, along, across in (("_gx", "col", "row"), ("_gy", "row", "col")):
        tile, place = F.floor(F.col(along) / LINE), F.pmod(F.col(along), F.lit(LINE))
        lent = F.array_compact(F.array(F.lit(0), F.when(place == 0, -1), F.when(place == LINE - 1, 1)))
        out = out.withColumn("_lent", F.explode(lent)).withColumn("_tile", tile + F.col("_lent"))
        w = W.partitionBy(across, "_tile").orderBy(along)
        prev = F.when(F.lag(along).over(w) == F.col(along) - 1, F.lag(value).over(w))
        nxt = F.when(F.lead(along).over(w) == F.col(along) + 1, F.lead(value).over(w))
        diff = (
            F.when(prev.isNotNull() & nxt.isNotNull(), (nxt - prev) / 2)
            .when(nxt.isNotNull(), nxt - F.col(value))
            .when(prev.isNotNull(), F.col(value) - prev)
        )
        out = out.withColumn(name, diff / size).where(F.col("_lent") == 0).drop("_lent", "_tile")
    steep = F.degrees(F.atan(F.hypot("_gx", "_gy")))
    aspect = F.atan2(-F.col("_gx"), F.col("_gy"))
    return out.withColumns({"slope_deg": steep, "northness_g": F.cos(aspect), "eastness_g": F.sin(aspect)}).drop("_gx", "_gy")


def block_average(grid: DataFrame, value: str, factor: int) -> DataFrame:
    return grid.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(
        F.avg(value).alias(value), F.count(value).alias("n")
    )


def upsample(grid: DataFrame, factor: int) -> DataFrame:
    """Repeat each cell factor x factor times."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    rest = [x for x in grid.columns if x not in ("row", "col")]
    out = grid.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    return out.select((F.col("row") * factor + F.col("_i")).alias("row"), (F.col("col") * factor + F.col("_j")).alias("col"), *rest)


def mask_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells in a, in b, in both, in either, and their ratio; one grouped pass over the union."""
    both = a.select("row", "col", F.lit(1).alias("ia"), F.lit(0).alias("ib")).unionByName(
        b.select("row", "col", F.lit(0).alias("ia"), F.lit(1).alias("ib"))
    )
    cells = both.groupBy("row", "col").agg(F.max("ia").alias("ia"), F.max("ib").alias("ib"))
    out = cells.agg(
        F.sum("ia").alias("n_a"), F.sum("ib").alias("n_b"), F.sum(F.col("ia") * F.col("ib")).alias("n_both"), F.count(F.lit(1)).alias("n_either")
    )
    return out.withColumn("jaccard", F.col("n_both") / F.col("n_either"))


def first_valid(frames: list[DataFrame], value: str) -> DataFrame:
    """Mosaic: the value of the first frame that has one at a cell."""
    ranked = [f.select("row", "col", value).withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)]
    stacked = reduce(DataFrame.unionByName, ranked).where(F.col(value).isNotNull())
    return stacked.groupBy("row", "col").agg(F.min_by(value, "_rank").alias(value))


def largest_valid(frames: list[DataFrame], value: str) -> DataFrame:
    """Mosaic: the largest value that any frame has at a cell."""
    stacked = reduce(DataFrame.unionByName, [f.select("row", "col", value) for f in frames])
    return stacked.where(F.col(value).isNotNull()).groupBy("row", "col").agg(F.max(value).alias(value))


def majority_code(px: DataFrame, unit: str, code: str) -> DataFrame:
    """Most frequent code per unit, the smallest on a tie; codes are counted before anything is compared."""
    counts = px.groupBy(unit, code).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(unit).agg(F.min_by(code, F.struct(-F.col("_n"), F.col(code))).alias(code), F.max("_n").alias("n_votes"))


def last_event_year(sources: list[DataFrame]) -> DataFrame:
    """Latest event year per cell over all sources (row, col, year)."""
    return reduce(DataFrame.unionByName, sources).groupBy("row", "col").agg(F.max("year").alias("last_year"))


def redisturbed_share(unit_px: DataFrame, last: DataFrame, unit: str, year: str) -> DataFrame:
    """Share of a unit's cells with an event after the unit's own year."""
    later = F.coalesce(F.col("last_year") > F.col(year), F.lit(False)).cast("double")
    return unit_px.join(last, ["row", "col"], "left").groupBy(unit, year).agg(F.avg(later).alias("redist_frac"))
