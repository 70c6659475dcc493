"""Grouped aggregates, bounds, and the keys that changed rows affect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.buckets import boundary
from tidemark.functions.hashing import group_hash, row_hash_int
from tidemark.spec import Dimension
from tidemark.work import saved


def grouped(df: DataFrame, keys: dict[str, str], aggregates: dict[str, str], hashed: list[str] | None = None, hash_name: str = "group_hash") -> DataFrame:
    """Aggregates (SQL) by computed keys (SQL); ``hashed`` adds the hash over each group's raw rows."""
    if hashed:
        df = df.withColumn("_h", row_hash_int(hashed))
    values = [F.expr(e).alias(n) for n, e in aggregates.items()] + ([group_hash("_h").alias(hash_name)] if hashed else [])
    return df.groupBy(*[F.expr(e).alias(n) for n, e in keys.items()]).agg(*values)


def column_limits(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the least and greatest value of each column, in one pass."""
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "min"), (F.max, "max"))])


def watermark(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).alias("watermark"))


def chunked(keys: DataFrame, order: list[str], size: int, within: list[str] = ()) -> DataFrame:
    """``keys`` with the chunk of ``size`` keys that each is in, in sorted order within a group; one
    chunk if the size is -1.

    Numbers come from counts of ranges: rows are numbered within ranges of the sort order, and
    ranges are shifted by the counts before them, so that no task sorts all keys. Keys are written down
    with their range, which two branches read.
    """
    if size == -1:
        return keys.withColumn("chunk", F.lit(0).cast("long"))
    ranged = saved(keys.repartitionByRange(*within, *order).withColumn("_range", F.spark_partition_id()))
    local = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_range", *within).orderBy(*order)))
    counts = ranged.groupBy("_range", *within).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = local.join(before, ["_range", *within])
    at = F.col("_before") + F.col("_at") - 1
    return numbered.withColumn("chunk", F.call_function("div", at, F.lit(size).cast("long"))).drop("_range", "_at", "_before")


def affected_ranges(changed: DataFrame, dims: list[Dimension]) -> DataFrame:
    """The buckets that changed rows fall in, with bounds and numbers of rows."""
    columns: list[Column] = []
    for d in dims:
        start, end = boundary(d)
        columns += [start.alias(f"{d.column}_start"), end.alias(f"{d.column}_end")]
    return changed.select(*columns).groupBy(*[c for d in dims for c in (f"{d.column}_start", f"{d.column}_end")]).agg(F.count("*").alias("num_rows"))


def affected_values(changed: DataFrame, dims: list[Dimension]) -> DataFrame:
    """Distinct key tuples of changed rows, in chunks of the least positive step."""
    names = [d.column for d in dims]
    steps = [d.step for d in dims if d.step > 0]
    return chunked(changed.select(*names).distinct(), names, min(steps) if steps else -1)


def affected_mixed(changed: DataFrame, ranges: list[Dimension], values: list[Dimension]) -> DataFrame:
    """Distinct (range, key tuple) of changed rows, tuples chunked within each range."""
    bounds_: list[Column] = []
    for d in ranges:
        start, end = boundary(d)
        bounds_ += [start.alias(f"{d.column}_start"), end.alias(f"{d.column}_end")]
    names = [d.column for d in values]
    steps = [d.step for d in values if d.step > 0]
    keys = changed.select(*bounds_, *names).distinct()
    return chunked(keys, names, min(steps) if steps else -1, [c for d in ranges for c in (f"{d.column}_start", f"{d.column}_end")])
