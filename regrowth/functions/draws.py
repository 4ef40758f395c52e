"""Reproducible uniform draws that depend on the key only, never on partitions or task order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

POISSON_STEPS = [  # fixed values: cumulative probabilities of a Poisson(1) count 0..7
    0.36787944117144233,
    0.7357588823428847,
    0.9196986029286058,
    0.9810118431238462,
    0.9963401531726563,
    0.9994058151824183,
    0.9999167588507119,
    0.9999897508033253,
]


def uniform(*parts) -> Column:
    """u in [0, 1) from the first 32 bits of md5 over the parts joined by '-'."""
    text = F.concat_ws("-", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def poisson_count(u: Column) -> Column:
    """Inverse of the Poisson(1) distribution function."""
    total = F.lit(0)
    for step in POISSON_STEPS:
        total = total + F.when(u >= F.lit(step), 1).otherwise(0)
    return total.cast("long")
