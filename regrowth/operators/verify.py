"""Comparing result sets and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def close(a, b, tol: float) -> Column:
    """Within a relative tolerance, two missing values (NULL or NaN) being equal."""
    a, b = F.nanvl(F.col(a), F.lit(None)), F.nanvl(F.col(b), F.lit(None))
    near = F.abs(a - b) <= F.lit(tol) * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    return F.when(a.isNull() & b.isNull(), True).otherwise(F.coalesce(near, F.lit(False)))


def result_diff(old: DataFrame, new: DataFrame, key: str, value: str, tol: float = 1e-9) -> DataFrame:
    """Keys whose values differ or that only one side has."""
    a = old.select(F.col(key), F.col(value).cast("double").alias("old_value"), F.lit(True).alias("_a"))
    b = new.select(F.col(key), F.col(value).cast("double").alias("new_value"), F.lit(True).alias("_b"))
    both = a.join(b, key, "full")
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "missing").when(~close("old_value", "new_value", tol), "changed")
    return both.withColumn("status", status).where(F.col("status").isNotNull()).drop("_a", "_b")


def table_diff(old: DataFrame, new: DataFrame, keys: list[str], tol: float = 1e-9) -> DataFrame:
    """Per column: mismatches and the largest absolute gap over rows matched by key, with both row counts."""
    values = [c for c in old.columns if c not in keys and c in new.columns]
    a = old.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(1).alias("_a"))
    b = new.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(1).alias("_b"))
    both = a.join(b, keys, "full")
    kinds = {f.name: f.dataType.typeName() for f in old.schema}
    aggs = [F.count("_a").alias("_n_a"), F.count("_b").alias("_n_b")]
    for v in values:
        numeric = kinds[v] in ("double", "float", "integer", "long", "short", "byte", "decimal")
        matched = F.col("_a").isNotNull() & F.col("_b").isNotNull()
        if kinds[v] in ("double", "float"):
            same = close(f"a_{v}", f"b_{v}", tol)
        else:
            same = F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}"))
        aggs.append(F.count_if(matched & ~same).alias(f"m_{v}"))
        gap = F.abs(F.col(f"a_{v}").cast("double") - F.col(f"b_{v}").cast("double")) if numeric else F.lit(None).cast("double")
        aggs.append(F.max(F.when(matched, gap)).alias(f"g_{v}"))
    one = both.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(v).alias("column_name"), F.col(f"m_{v}").alias("mismatches"), F.col(f"g_{v}").alias("max_gap")) for v in values])
    return one.select("_n_a", "_n_b", F.inline(rows)).withColumnsRenamed({"_n_a": "rows_old", "_n_b": "rows_new"})
