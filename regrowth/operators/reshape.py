"""Wide and long panels, event time, reference levels, dimensions and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from regrowth.functions import columns as fc
from regrowth.operators.ranking import global_row_number
from regrowth.sources.tables import present


def wide_to_long(wide: DataFrame, keep: list[str], periods: dict[str, float], t_event: str = "t_event", tag: str = "pre_tag") -> DataFrame:
    """One row per unit and period that has a ``dlst`` value; ``dndvi`` may be NULL. Absent periods are skipped."""
    have = [p for p in periods if present(wide, [f"dlst_{p}"])]
    cells = [
        F.struct(
            F.lit(p).alias("epoch"),
            F.lit(float(periods[p])).alias("mid"),
            F.col(f"dlst_{p}").alias("dlst"),
            (F.col(f"dndvi_{p}") if present(wide, [f"dndvi_{p}"]) else F.lit(None).cast("double")).alias("dndvi"),
        )
        for p in have
    ]
    rows = wide.select(*keep, t_event, tag, F.inline(F.filter(F.array(*cells), lambda x: x["dlst"].isNotNull())))
    return rows.withColumn("age", F.col("mid") - F.col(t_event)).withColumn("is_pre", F.col("epoch") == F.col(tag))


def long_to_wide(long: DataFrame, keys: list[str], period: str, periods: list[str], values: list[str]) -> DataFrame:
    aggs = [
        F.max(F.when(F.col(period) == p, F.col(v))).alias(f"{v}_{p}") for p in periods for v in values
    ]
    # a period outside the list would vanish: it stops the query instead
    message = F.concat(F.lit("period not listed: "), F.coalesce(F.col(period).cast("string"), F.lit("null")))
    first = F.when(F.col(period).isin(periods), F.col(values[0])).otherwise(F.raise_error(message).cast("double"))
    return long.withColumn(values[0], first).groupBy(*keys).agg(*aggs)


def reference_lookup(long: DataFrame, unit: str, value: str, flag: Column) -> DataFrame:
    """The value of the row each unit marks as its reference: (unit, reference)."""
    marked = long.where(flag & F.col(value).isNotNull())
    return marked.groupBy(unit).agg(F.max_by(value, "epoch").alias("reference"))


def net_of_reference(long: DataFrame, reference: DataFrame, unit: str, value: str, out: str = "beta") -> DataFrame:
    """Inner join on the unit: units without a reference drop out."""
    joined = long.where(F.col(value).isNotNull()).join(reference, unit)
    return joined.withColumn(out, F.col(value) - F.col("reference"))


def pre_mean(long: DataFrame, unit: str, value: str, flag: Column) -> DataFrame:
    return long.where(flag & F.col(value).isNotNull()).groupBy(unit).agg(F.avg(value).alias("reference"))


def surrogate_key(df: DataFrame, keys: list[str], name: str = "gid") -> DataFrame:
    """Group number of a composite key in sorted order, from 1; rows with a NULL key part drop out."""
    cond = None
    for k in keys:
        term = F.col(k).isNotNull()
        cond = term if cond is None else cond & term
    rows = df.where(cond)
    dim = global_row_number(rows.select(*keys).distinct(), keys, name)
    return rows.join(dim, keys)


def code_dimension(df: DataFrame, year: str, text: str) -> DataFrame:
    """Event dimension: sorted distinct (year, text) numbered from 1, with counts."""
    dim = df.groupBy(year, text).agg(F.count(F.lit(1)).alias("n"))
    return global_row_number(dim, [year, text], "code")


def repair_dimension(dim: DataFrame, fixes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Take the corrected value where the correction table has one."""
    right = fixes.select(key, *[F.col(x).alias(f"_new_{x}") for x in columns])
    out = dim.join(right, key, "left")
    for x in columns:
        out = out.withColumn(x, F.coalesce(F.col(f"_new_{x}"), F.col(x)))
    return out.drop(*[f"_new_{x}" for x in columns])


def resolve_event_date(df: DataFrame, canon: DataFrame, year: str, text: str, before: str, after: str) -> DataFrame:
    """Event date and how it was found.

    Known date of the named event, else a leading MMDD in a single-event name; a date more than 45 days outside
    the image bracket is dropped. Then the middle of the bracket, then 15 July.
    """
    name = fc.tidy_text(text)
    base = df.withColumns({"_name": name, "_b": fc.parse_date(before), "_a": fc.parse_date(after)})
    known = canon.select(F.col("year").alias(year), F.col("name").alias("_name"), F.col("date").alias("_known"))
    base = base.join(known, [year, "_name"], "left")
    single = ~F.col("_name").contains(fc.LIST_MARK) & ~F.col("_name").contains(fc.AND_MARK)
    mmdd = F.regexp_extract("_name", r"^([0-9]{4})", 1)
    from_name = F.when(
        single & (mmdd != ""),
        F.try_to_timestamp(F.concat(F.col(year).cast("string"), mmdd), F.lit("yyyyMMdd")).cast("date"),
    )
    first = F.coalesce("_known", from_name)
    first_q = F.when(F.col("_known").isNotNull(), "canonical").when(from_name.isNotNull(), "mmdd")
    both = F.col("_b").isNotNull() & F.col("_a").isNotNull()
    trusted = ~both | F.coalesce(first.between(F.date_sub("_b", 45), F.date_add("_a", 45)), F.lit(False))
    middle = F.when(both, F.date_add("_b", F.floor(F.datediff("_a", "_b") / 2).cast("int")))
    kept = F.when(trusted, first)
    date = F.coalesce(kept, middle, F.make_date(F.col(year).cast("int"), F.lit(7), F.lit(15)))
    quality = (
        F.when(kept.isNotNull(), first_q).when(middle.isNotNull(), F.lit("midpoint")).otherwise(F.lit("yearmid"))
    )
    out = base.withColumns(
        {
            "event_date": date,
            "dq": quality,
            "bracket_days": F.when(both, F.datediff("_a", "_b")).otherwise(F.lit(-1)),
        }
    )
    return out.withColumn("t_event", fc.decimal_year("event_date")).drop("_name", "_b", "_a", "_known")
