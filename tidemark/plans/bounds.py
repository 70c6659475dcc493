"""Bounds of a run: what part of the key or time space it looks at."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_bounds(src: DataFrame, dst: DataFrame, column: str, strategy: str, start: Any = None, end: Any = None) -> DataFrame:
    """One row (lo, hi), hi inside: full takes the source's limits; delta starts at the destination's
    greatest value, or at the source's least if the destination is empty, and ends at the source's
    greatest; hash spans both sides. Configured bounds win."""
    s = src.agg(F.min(column).alias("s_lo"), F.max(column).alias("s_hi"))
    d = dst.agg(F.min(column).alias("d_lo"), F.max(column).alias("d_hi"))
    both = s.crossJoin(d)  # one row each
    lo, hi = {
        "full": (F.col("s_lo"), F.col("s_hi")),
        "delta": (F.coalesce("d_hi", "s_lo"), F.col("s_hi")),
        "hash": (F.least("s_lo", "d_lo"), F.greatest("s_hi", "d_hi")),
    }[strategy]
    return both.select((F.lit(start) if start is not None else lo).alias("lo"), (F.lit(end) if end is not None else hi).alias("hi"))


def extremes(df: DataFrame, column: str) -> tuple[Column, Column] | None:
    """The least and greatest value of a column as literals of its type, None if there is none. Two values reach
    the driver; as literals in a filter they go on to a scan, which then skips files and row groups."""
    kind = df.select(column).schema[0].dataType
    low, high = F.min(column), F.max(column)
    back = lambda v: F.lit(v).cast(kind)
    match kind.simpleString():
        case "timestamp":  # text would be ambiguous where clocks are set back
            low, high, back = F.unix_micros(low), F.unix_micros(high), lambda v: F.timestamp_micros(F.lit(v))
        case "timestamp_ntz" | "date":
            low, high = low.cast("string"), high.cast("string")
    found = df.agg(low, high).first()
    return None if found[0] is None else (back(found[0]), back(found[1]))


def greatest(df: DataFrame, column: str) -> Column | None:
    """The high watermark: the greatest value of a column as a literal, None if there is none."""
    found = extremes(df, column)
    return found and found[1]
