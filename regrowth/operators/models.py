"""Boosted-tree height model with MLlib, partial dependence and counterfactuals.

Trees see a feature by its bin only (``BINS`` of them), and a squared-error split by counts and sums of the label. So the rows are
summed by cell (the bins of all features) once, and MLlib boosts over the cells with their mean label, weighted by their rows: the
splits are those of the rows, while what the rounds read is bounded by the cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, functions as F

from regrowth.functions.draws import uniform
from regrowth.operators.quantiles import exact_quantiles
from regrowth.session import materialise, shared_root

#: Bins of a feature, and quantiles of which its edges are taken; rows that a node has at least.
BINS, FINE, LEAST_ROWS = 32, 512, 50
#: The method's rounds and learning rate. Its trees have 31 leaves, the best first and to any depth; MLlib grows level by level, and
#: five levels have 32.
ROUNDS, STEP, DEPTH = 400, 0.08, 5


@dataclass
class BinnedModel:
    """Boosted trees over bins; ``edges`` are the lower ends of a feature's bins but for the first, which has none."""

    trees: GBTRegressionModel
    edges: list[list[float]]


def split_by_key(df: DataFrame, keys: list[str], test_share: float, seed: str) -> tuple[DataFrame, DataFrame]:
    """Train and test rows from keyed draws: the same split however the data is partitioned."""
    drawn = df.withColumn("_u", uniform(F.lit(seed), *keys))
    return drawn.where(F.col("_u") >= test_share).drop("_u"), drawn.where(F.col("_u") < test_share).drop("_u")


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def bin_edges(df: DataFrame, features: list[str]) -> list[list[float]]:
    """Of every feature, from all rows: its values where it has few, else its quantiles."""
    steps = [i / FINE for i in range(FINE)]
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), steps, 20 * FINE).alias(f) for f in features]).first()
    out = []
    for fine in row:
        values = sorted(set(fine or [0.0]))
        if len(values) > BINS:
            values = sorted(set(fine[:: FINE // BINS]))
        out.append(values[1:] or values)
    return out


def binned(df: DataFrame, features: list[str], edges: list[list[float]]) -> DataFrame:
    """With the bins as ``_bin_<feature>``; a missing value is an error."""
    ends = [[-float("inf"), *e, float("inf")] for e in edges]
    return Bucketizer(inputCols=features, outputCols=[f"_bin_{f}" for f in features], splitsArray=ends).transform(df)


def cells(df: DataFrame, features: list[str], label: str, edges: list[list[float]]) -> DataFrame:
    """(_bin_<feature>..., n, label): rows and mean label of every combination of bins, by one aggregate over a packed key."""
    if len(features) > 12:
        raise ValueError("a packed cell holds 12 features")
    packed = sum(F.col(f"_bin_{f}").cast("long") * F.lit(BINS**k) for k, f in enumerate(features))
    found = binned(df, features, edges).groupBy(packed.alias("_cell")).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias(label))
    bins = [F.floor(F.col("_cell") / BINS**k).bitwiseAND(F.lit(BINS - 1)).cast("double").alias(f"_bin_{f}") for k, f in enumerate(features)]
    return found.select(*bins, "n", label)


def fit_boosted(train: DataFrame, features: list[str], label: str, rounds: int = ROUNDS, depth: int = DEPTH) -> BinnedModel:
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # the rows' errors descend from round to round; MLlib cuts that line by checkpoints
        context.setCheckpointDir(shared_root(train.sparkSession))
    edges = bin_edges(train, features)
    held = materialise(cells(train, features, label, edges), "cells")
    n = held.agg(F.sum("n")).first()[0] or 0
    # a node's least number of rows is a share of the weight, as a cell stands for many; under twice as many rows nothing is split
    share, depth = (min((LEAST_ROWS - 0.5) / n, 0.4999), depth) if n >= 2 * LEAST_ROWS else (0.0, 0)
    # splits between bins are found in a sample of cells, whose size follows maxBins
    trees = GBTRegressor(
        featuresCol="features", labelCol=label, weightCol="n", maxIter=rounds, stepSize=STEP, maxDepth=depth, maxBins=8 * BINS, minWeightFractionPerNode=share, seed=42
    )
    return BinnedModel(trees.fit(assemble(held, [f"_bin_{f}" for f in features]).select("features", label, F.col("n").cast("double").alias("n"))), edges)


def typical_rows(df: DataFrame, keys: list[str], features: list[str], also: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """Exact median of every feature per group, all features in one selection; ``also`` has further columns as (feature, quantile)."""
    also = also or {}
    values = [x for f in features for x in (F.lit(f), F.col(f).cast("double"))]
    long = df.select(*keys, F.stack(F.lit(len(features)), *values).alias("_feature", "_value"))
    probs = sorted({0.5, *(p for _, p in also.values())})
    found = exact_quantiles(long, [*keys, "_feature"], "_value", probs, [f"_q{i}" for i in range(len(probs))], repeated=True)
    pick = lambda f, p: F.max(F.when(F.col("_feature") == f, F.col(f"_q{probs.index(p)}")))
    return found.groupBy(*keys).agg(*[pick(f, 0.5).alias(f) for f in features], *[pick(*at).alias(name) for name, at in also.items()])


def vary(base: DataFrame, feature: str, values: list[float]) -> DataFrame:
    """Copies of the base rows with one feature set to each value."""
    return base.withColumn(feature, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def predict(model: BinnedModel, rows: DataFrame, features: list[str]) -> DataFrame:
    bins = [f"_bin_{f}" for f in features]
    return model.trees.transform(assemble(binned(rows, features, model.edges), bins)).drop("features", *bins)
