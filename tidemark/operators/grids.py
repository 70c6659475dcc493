"""Grids of partitions: one row per cell, made from one row of bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.buckets import bounds, floor_div, unit_index, unit_start
from tidemark.spec import Dimension


def _cells(frame: DataFrame, first: Column, last: Column) -> DataFrame:
    """Cells first..last of each row; none where last is before first."""
    return frame.withColumn("cell", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.expr("cast(array() as array<bigint>)"))))


def int_grid(limits: DataFrame, step: int, bounded: bool = False) -> DataFrame:
    """Cells of [lo, hi) of ``limits``: partition_id, start_, end_. Aligned cells are multiples of the
    step and may reach over the limits; bounded ones start at lo, are cut at hi and count from 0."""
    lo, hi = F.col("lo").cast("long"), F.col("hi").cast("long")
    if bounded:
        cells = _cells(limits, F.lit(0).cast("long"), floor_div(hi - lo - 1, step))
        start = lo + F.col("cell") * step
        return cells.select(F.col("cell").alias("partition_id"), start.alias("start_"), F.least(start + step, hi).alias("end_"))
    cells = _cells(limits, floor_div(lo, step), floor_div(hi - 1, step))
    return cells.select(F.col("cell").alias("partition_id"), (F.col("cell") * step).alias("start_"), ((F.col("cell") + 1) * step).alias("end_"))


def datetime_cells(limits: DataFrame, step: int, unit: str, date: bool = False) -> DataFrame:
    """Cells of [lo, hi) of ``limits`` in steps of a unit: partition_id, start_ and end_ of groups of units
    counted from 1970, and cut_start and cut_end, which are the same cut at the limits."""
    lo, hi = F.col("lo").cast("timestamp_ntz"), F.col("hi").cast("timestamp_ntz")
    # the last cell starts before hi: where hi is itself a start, that is the cell before
    limits = limits.withColumns({"_first": floor_div(unit_index(lo, unit), step), "_hi": floor_div(unit_index(hi, unit), step)})
    last = F.when(unit_start(F.col("_hi") * step, unit) == hi, F.col("_hi") - 1).otherwise(F.col("_hi"))
    cells = _cells(limits, F.col("_first"), last)
    start, end = unit_start(F.col("cell") * step, unit), unit_start((F.col("cell") + 1) * step, unit)
    kind = "date" if date else "timestamp_ntz"
    named = {"start_": start, "end_": end, "cut_start": F.greatest(start, lo), "cut_end": F.least(end, hi)}
    return cells.select(F.col("cell").alias("partition_id"), *[c.cast(kind).alias(n) for n, c in named.items()])


def datetime_grid(limits: DataFrame, step: int, unit: str, bounded: bool = False, date: bool = False) -> DataFrame:
    """``datetime_cells`` with one pair of bounds, start_ and end_: aligned cells start at groups of units,
    bounded ones are cut at the limits."""
    cells = datetime_cells(limits, step, unit, date)
    return cells.select("partition_id", F.col("cut_start").alias("start_"), F.col("cut_end").alias("end_")) if bounded else cells.select("partition_id", "start_", "end_")


def _uuid_text(prefix: Column, fill: str, form: str) -> Column:
    text = F.concat(F.lpad(F.lower(F.hex(prefix)), 8, "0"), F.lit(fill * 24))
    if form == "uuid_text":
        return text
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(text, a, n) for a, n in cuts])


def uuid_grid(limits: DataFrame, step: int, form: str = "uuid") -> DataFrame:
    """Cells of the space of UUIDs by their first eight hex digits, from lo to hi of ``limits``
    (prefixes as numbers, hi included): partition_id, start_, end_, last_. The last cell of the space
    ends with its greatest value, which is inside."""
    top = 1 << 32
    cells = _cells(limits, floor_div("lo", step), floor_div("hi", step))
    end = (F.col("cell") + 1) * step
    last = end >= top
    return cells.select(
        F.col("cell").alias("partition_id"),
        _uuid_text(F.col("cell") * step, "0", form).alias("start_"),
        F.when(last, _uuid_text(F.lit(top - 1), "f", form)).otherwise(_uuid_text(end, "0", form)).alias("end_"),
        last.alias("last_"),
    )


def product(grids: dict[str, DataFrame]) -> DataFrame:
    """The cross product of one-dimensional grids, with joined ids and each dimension's bounds. Which side
    is broadcast is left to Spark, as steps of seconds over years make many cells."""
    out, ids = None, []
    for name, g in grids.items():
        g = g.select(F.col("partition_id").alias(f"{name}_id"), F.col("start_").alias(f"{name}_start"), F.col("end_").alias(f"{name}_end"))
        ids.append(F.col(f"{name}_id").cast("string"))
        out = g if out is None else out.crossJoin(g)
    return out.withColumn("partition_id", F.concat_ws("-", *ids))


def children(parents: DataFrame, step: int) -> DataFrame:
    """Cells of a finer integer step inside each parent (partition_id, start_, end_), cut at its
    bounds; ids follow the parent's after a hyphen."""
    cells = _cells(parents, floor_div("start_", step), floor_div(F.col("end_") - 1, step))
    return cells.select(
        F.concat_ws("-", F.col("partition_id").cast("string"), F.col("cell").cast("string")).alias("partition_id"),
        F.col("partition_id").alias("parent_id"),
        F.greatest(F.col("cell") * step, F.col("start_")).alias("start_"),
        F.least((F.col("cell") + 1) * step, F.col("end_")).alias("end_"),
    )


def bucket_bounds(ids: DataFrame, d: Dimension, column: str = "partition_id") -> DataFrame:
    start, end = bounds(d, column)
    return ids.withColumns({"start_": start, "end_": end})

