"""Sums of every bootstrap replicate as vectors.

A unit is one row with its few cells' sums. A task draws the units' weights for all replicates, multiplies, and hands on one
vector of B numbers per cell and sum, so what is shuffled after the unit rows is tasks x cells vectors, never units x B rows.

* poisson: a unit's weights come from its own key.
* multinomial: N draws of N units per replicate. Units are dealt to slices by their key; the draws of a replicate are split
  over the slices down a binary tree (binomial counts from numbers keyed by replicate and node), and inside a slice each draw
  picks a unit by a number keyed by replicate, slice and draw. Every slice finds its own share of every replicate from the
  slices' sizes alone, so slices never talk to each other, and the counts of a replicate add up to N.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, functions as F, types as T

from regrowth.functions.draws import POISSON_STEPS
from regrowth.session import materialise

register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

#: Units of a slice, about, and the least number of slices (both powers of two); replicates whose weights are held at a time.
SLICE_UNITS, LEAST_SLICES, AT_A_TIME = 1 << 16, 8, 16
#: Units whose Poisson weights are drawn at a time.
POISSON_UNITS = 1024
#: Vectors that are added up together on the way to a cell's total.
FAN_IN = 64
_STEPS = np.array(POISSON_STEPS)


def keyed(text: str) -> float:
    """u in [0, 1) from the first 32 bits of md5; the same number as ``draws.uniform``."""
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:4], "big") / 4294967296.0


def poisson_weights(seed: str, units: list[str], n_boot: int) -> np.ndarray:
    """Poisson(1) counts, units x replicates."""
    u = np.array([[keyed(f"{seed}-{x}-{rep}") for rep in range(1, n_boot + 1)] for x in units]).reshape(len(units), n_boot)
    return np.searchsorted(_STEPS, u, side="right").astype(np.float64)


def binomial_quantile(n: int, p: float, u: float) -> int:
    """Least k with P(X <= k) >= u, over the range that holds all but some 1e-30 of the distribution."""
    if n == 0 or p <= 0:
        return 0
    if p >= 1:
        return n
    mode, spread = int((n + 1) * p), 12 * math.sqrt(n * p * (1 - p)) + 40
    lo, hi = max(0, int(mode - spread)), min(n, int(mode + spread))
    k = np.arange(lo + 1, hi + 1)
    log = np.concatenate([[0.0], np.cumsum(np.log((n - k + 1) / k * (p / (1 - p))))])
    below = np.cumsum(np.exp(log - log.max()))
    return min(hi, lo + int(np.searchsorted(below / below[-1], u, side="left")))


def slice_share(seed: str, rep: int, sizes: list[int], own: int) -> int:
    """How many of a replicate's draws fall into slice ``own``: the counts along its path down the tree."""
    first, width, node, level, draws = 0, len(sizes), 0, 0, sum(sizes)
    while width > 1:
        half = width // 2
        left, whole = sum(sizes[first : first + half]), sum(sizes[first : first + width])
        p = left / whole if whole else 0.0
        to_left = binomial_quantile(draws, p, keyed(f"{seed}-split-{level}-{node}-{rep}"))
        if own < first + half:
            draws, node = to_left, 2 * node
        else:
            draws, node, first = draws - to_left, 2 * node + 1, first + half
        width, level = half, level + 1
    return draws


def slice_weights(seed: str, units: int, sizes: list[int], own: int, reps: range) -> np.ndarray:
    """Counts of a slice's units (in their order), units x replicates."""
    out = np.zeros((units, len(reps)))
    for c, rep in enumerate(reps):
        share = slice_share(seed, rep, sizes, own)
        picks = np.array([int(keyed(f"{seed}-{rep}-{own}-{j}") * units) for j in range(share)], dtype=np.int64)
        out[:, c] = np.bincount(picks, minlength=units)
    return out


class _Cells:
    """The cells of many units as arrays: a cell's unit (its place in ``order``), its values, and the cells of each key."""

    def __init__(self, cells: pa.Array, order: np.ndarray | None = None):
        flat = cells if order is None else cells.take(pa.array(order))
        self.unit = np.repeat(np.arange(len(flat)), flat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = flat.flatten()
        values = flat.field("v")
        width = (len(values.flatten()) // len(values)) if len(values) else 0
        self.values = values.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(values), width)
        key, self.by_key = flat.field("key"), {}
        names = [] if key.null_count == len(key) else [f.name for f in key.type]
        if not names:
            self.by_key = {(): slice(None)} if len(flat) else {}
            return
        code = np.zeros(len(flat), dtype=np.int64)
        for i in range(len(names)):
            coded = key.field(i).dictionary_encode()
            own = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
            code = np.unique(code * (len(coded.dictionary) + 1) + own, return_inverse=True)[1]
        by_code = np.argsort(code, kind="stable")
        for rows in np.split(by_code, np.flatnonzero(np.diff(code[by_code])) + 1):
            self.by_key[tuple(key.field(i)[int(rows[0])].as_py() for i in range(len(names)))] = rows


class _Vectors:
    """Running sums per cell: replicates x values, with the weights' sum and the number of drawn units as the last two values."""

    def __init__(self, n_boot: int):
        self.n_boot, self.held = n_boot, {}

    def add(self, cells: "_Cells", first: int, weights: np.ndarray) -> None:
        """Cells of the units, and the weights of the replicates from ``first`` on."""
        for key, rows in cells.by_key.items():
            w, v = weights[cells.unit[rows]], cells.values[rows]
            if key not in self.held:
                self.held[key] = np.zeros((self.n_boot, v.shape[1] + 2))
            part = self.held[key][first : first + w.shape[1]]
            part[:, :-2] += w.T @ v
            part[:, -2] += w.sum(axis=0)
            part[:, -1] += (w > 0).sum(axis=0)

    def batch(self, part: int, schema: pa.Schema) -> pa.RecordBatch:
        keys = list(self.held)
        columns = [pa.array([part] * len(keys), pa.int64())] + [pa.array([k[i] for k in keys], f.type) for i, f in enumerate(list(schema)[1:-1])]
        columns.append(pa.array([v.ravel() for v in self.held.values()], schema.field("total").type))
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def _partial_schema(df: DataFrame, keys: list[str]) -> T.StructType:
    kept = [T.StructField(k, df.schema[k].dataType) for k in keys]
    return T.StructType([T.StructField("_part", T.LongType()), *kept, T.StructField("total", T.ArrayType(T.DoubleType()))])


def _sum_of(vectors: Column) -> Column:
    add = lambda a, b: F.when(F.size(a) == 0, b).otherwise(F.zip_with(a, b, lambda x, y: x + y))
    return F.aggregate(vectors, F.array().cast("array<double>"), add)


def unit_slices(units: DataFrame, unit: str) -> tuple[DataFrame, list[int]]:
    """``units`` with ``_slice`` (by the md5 of the key), and the slices' sizes: one number per some 65,000 units."""
    slices = max(LEAST_SLICES, 1 << max(0, (max(1, units.count()) - 1) // SLICE_UNITS).bit_length())
    number = F.conv(F.substring(F.md5(F.col(unit).cast("string")), 1, 8), 16, 10).cast("long")
    dealt = units.withColumn("_slice", number % slices)
    sizes = [0] * slices
    for row in dealt.groupBy("_slice").agg(F.count(F.lit(1)).alias("n")).where(F.col("_slice").isNotNull()).collect():
        sizes[row["_slice"]] = row["n"]
    return dealt.where(F.col("_slice").isNotNull()), sizes


def replicate_sums(sums: DataFrame, unit: str, keys: list[str], values: list[str], n_boot: int, seed: str, scheme: str = "multinomial") -> DataFrame:
    """(rep, keys, values, draws, n_units) for each replicate and cell with a drawn unit.

    ``sums`` has one row per unit and cell; a value is a number, or an array of numbers of one length (added element by element).
    ``draws`` is the sum of the weights of the cell's units, ``n_units`` how many different ones were drawn. A null key is a cell.
    """
    arrays = [v for v in values if isinstance(sums.schema[v].dataType, T.ArrayType)]
    if arrays and len(values) > 1:
        raise ValueError("an array of values stands alone")
    packed = F.col(arrays[0]).cast("array<double>") if arrays else F.array(*[F.col(v).cast("double") for v in values])
    key = F.struct(*keys) if keys else F.lit(None).cast("struct<none:int>")
    cells = sums.groupBy(unit).agg(F.collect_list(F.struct(key.alias("key"), packed.alias("v"))).alias("_cells")).where(F.col(unit).isNotNull())
    cells = cells.select(F.col(unit).cast("string").alias("_unit"), "_cells")
    schema = _partial_schema(sums, keys)
    arrow = pa.schema([pa.field(f.name, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "date": pa.date32()}.get(f.dataType.simpleString(), pa.list_(pa.float64()))) for f in schema.fields])

    if scheme == "poisson":
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, part = _Vectors(n_boot), 0
            for batch in batches:
                units = batch.column("_unit").to_pylist()
                part = int.from_bytes(hashlib.md5(units[0].encode()).digest()[:4], "big") if units else part
                for at in range(0, len(units), POISSON_UNITS):
                    held.add(_Cells(batch.column("_cells").slice(at, POISSON_UNITS)), 0, poisson_weights(seed, units[at : at + POISSON_UNITS], n_boot))
            yield held.batch(part, arrow)

        partial = cells.mapInArrow(run, schema)
    else:
        cells, sizes = unit_slices(materialise(cells, "unit-cells"), "_unit")

        def run_slice(table: pa.Table) -> pa.Table:
            units = table.column("_unit").to_pylist()
            order = sorted(range(len(units)), key=lambda i: (hashlib.md5(units[i].encode()).hexdigest(), units[i]))
            own = table.column("_slice")[0].as_py()
            held, cells = _Vectors(n_boot), _Cells(table.column("_cells").combine_chunks(), np.array(order))
            for first in range(0, n_boot, AT_A_TIME):
                held.add(cells, first, slice_weights(seed, len(order), sizes, own, range(first + 1, min(n_boot, first + AT_A_TIME) + 1)))
            return pa.Table.from_batches([held.batch(own, arrow)])

        partial = cells.groupBy("_slice").applyInArrow(run_slice, schema)

    some = partial.withColumn("_part", F.col("_part") % FAN_IN).groupBy("_part", *keys).agg(_sum_of(F.collect_list("total")).alias("total"))
    total = some.groupBy(*keys).agg(_sum_of(F.collect_list("total")).alias("total")).where(F.size("total") > 0)
    width = (F.size("total") / n_boot).cast("int")
    one = F.transform(F.sequence(F.lit(1), F.lit(n_boot)), lambda rep: F.struct(rep.alias("rep"), F.slice("total", (rep - 1) * width + 1, width).alias("v")))
    rows = total.select(*keys, F.inline(one))
    if arrays:
        size = F.size("v")
        out = [F.slice("v", F.lit(1), size - 2).alias(values[0]), F.element_at("v", -2).alias("draws"), F.element_at("v", -1).alias("n_units")]
    else:
        out = [F.get("v", F.lit(i)).alias(name) for i, name in enumerate([*values, "draws", "n_units"])]
    rows = rows.select("rep", *keys, *out).where(F.col("n_units") > 0)
    return rows.withColumns({"draws": F.col("draws").cast("long"), "n_units": F.col("n_units").cast("long")})


def multinomial_table(units: DataFrame, unit: str, n_boot: int, seed: str) -> DataFrame:
    """(unit, rep, w) with w > 0: the weights that ``replicate_sums`` draws, as rows, for callers that need them apart."""
    kind = units.schema[unit].dataType
    dealt, sizes = unit_slices(materialise(units.select(unit), "units"), unit)
    dealt = dealt.withColumn("_unit", F.col(unit).cast("string"))

    def run_slice(table: pa.Table) -> pa.Table:
        units = table.column("_unit").to_pylist()
        order = sorted(range(len(units)), key=lambda i: (hashlib.md5(units[i].encode()).hexdigest(), units[i]))
        w = slice_weights(seed, len(units), sizes, table.column("_slice")[0].as_py(), range(1, n_boot + 1))
        at, rep = np.nonzero(w)
        return pa.table({"_unit": pa.array([units[order[i]] for i in at], pa.string()), "rep": pa.array(rep + 1, pa.int32()), "w": pa.array(w[at, rep].astype(np.int64), pa.int64())})

    rows = dealt.groupBy("_slice").applyInArrow(run_slice, "_unit string, rep int, w long")
    return rows.select(F.col("_unit").cast(kind).alias(unit), "rep", "w")
