"""Predicates: comparisons, lists, tuples, half-open and lexicographic ranges, and mixtures."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
#: Values of a list above which it becomes a join with a frame of keys.
LONG_LIST = 1000


def compare(column: str, operator: str, value: Any) -> Column:
    """A comparison; a list with in / not in, where an empty list holds for no row / for every row,
    and a single value counts as a list of one. like, rlike and others are SQL operators."""
    c = F.col(column)
    match operator.lower():
        case "in" | "not in":
            values = list(value) if isinstance(value, (list, tuple, set)) else [value]
            inside = operator.lower() == "in"
            if not values:
                return F.lit(not inside)
            return c.isin(values) if inside else ~c.isin(values)
        case op if op in _COMPARE:
            return getattr(c, _COMPARE[op])(F.lit(value))
        case "like":
            return c.like(value)
        case "rlike":
            return c.rlike(value)
    raise ValueError(f"unknown operator: {operator}")


def half_open(column: str, start: Any, end: Any) -> Column:
    """start <= column < end, with values cast to the column's type by comparison; None is open."""
    parts = ([F.col(column) >= F.lit(start)] if start is not None else []) + ([F.col(column) < F.lit(end)] if end is not None else [])
    return reduce(and_, parts, F.lit(True))


def tuple_compare(df: DataFrame, columns: list[str], operator: str, values: tuple) -> Column:
    """Lexicographic comparison of several columns with a tuple, written as comparisons of single
    columns, so that the part on the first column reaches the scan."""
    if len(columns) != len(values):
        raise ValueError("as many values as columns are needed")
    if operator not in ("<", "<=", ">", ">="):
        raise ValueError(f"unknown operator: {operator}")
    strict = operator[0]
    cases = []
    for i, (c, v) in enumerate(zip(columns, values, strict=True)):
        equal = [F.col(a) == F.lit(b) for a, b in zip(columns[:i], values[:i], strict=True)]
        last = operator if i == len(columns) - 1 else strict
        cases.append(reduce(and_, [*equal, compare(c, last, v)]))
    return compare(columns[0], f"{strict}=", values[0]) & reduce(or_, cases)


def tuple_range(df: DataFrame, columns: list[str], start: tuple, end: tuple) -> DataFrame:
    """Rows with start <= (columns) < end in lexicographic order."""
    return df.where(tuple_compare(df, columns, ">=", start) & tuple_compare(df, columns, "<", end))


def key_frame(df: DataFrame, columns: list[str], tuples: list[tuple]) -> DataFrame:
    """Literal tuples as a frame of the columns' own types."""
    if any(len(t) != len(columns) for t in tuples):
        raise ValueError("as many values as columns are needed")
    fields = [df.schema[c] for c in columns]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return df.sparkSession.createDataFrame(tuples, schema)


def in_tuples(df: DataFrame, columns: list[str], tuples: list[tuple]) -> DataFrame:
    """Rows whose columns together are one of the tuples (not each among its own values)."""
    return df.join(F.broadcast(key_frame(df, columns, tuples)), columns, "left_semi") if len(tuples) <= LONG_LIST else df.join(key_frame(df, columns, tuples), columns, "left_semi")


def in_keys(df: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose key is among those of a frame, of any size."""
    return df.join(keys.select(*columns).distinct(), columns, "left_semi")


def mixed(df: DataFrame, ranges: dict[str, tuple], values: dict[str, list]) -> DataFrame:
    """Half-open ranges on some columns, lists on others; the lists' product is never formed."""
    conditions = [half_open(c, a, b) for c, (a, b) in ranges.items()] + [compare(c, "in", v) for c, v in values.items()]
    return df.where(reduce(and_, conditions, F.lit(True)))


def user_bounds(df: DataFrame, bounds: list[dict[str, Any]]) -> DataFrame:
    """Bounds per column: {column, start, end} or {column, value}, where value may be a list. A bound
    with both or neither is refused."""
    for b in bounds:
        ranged = b.get("start") is not None or b.get("end") is not None
        if ranged == (b.get("value") is not None):
            raise ValueError(f"either a range or values are needed: {b}")
        df = df.where(half_open(b["column"], b.get("start"), b.get("end")) if ranged else compare(b["column"], "in", b["value"]))
    return df
