"""Connected components of an edge table, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from regrowth.session import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable. Isolated nodes are not in ``edges`` and so not returned.

    Alternating stars: a round links every node to the smallest of its neighbours' side, first among larger neighbours and then
    among smaller ones, until no edge changes. Each minimum is a map-side combined aggregate joined back, so a hub is not
    gathered in one task. Every round's edges are written to the shared folder; a null end or a loop is left out.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    edges = materialise(edges, "edges")
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour of u, and u, go to the least of them (edges here run from larger u to smaller v)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small, "edges")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
