"""Named queries over the given tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register ``fn(spark, sf_dir)``; doubles of its result are rounded to ``digits`` places."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir), digits)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers as long: the same types on both sides of the check."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("double", "float"):
            cols.append((F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)).alias(f.name))
        elif kind in ("integer", "short", "byte"):
            cols.append(F.col(f.name).cast("long").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def r(expr: str, alias: str, digits: int = 6) -> str:
    """SQL twin of the rounding in ``tidy``."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0) AS {alias}"


def n(expr: str, alias: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {alias}"
