"""Bucket ids of values, bounds of buckets, and rounding of times, as Column expressions.

All arithmetic is on time without zone: results do not depend on the session's zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.spec import Dimension

_EPOCH = "DATE'1970-01-01'"
#: The Monday that week 0 starts with.
_FIRST_MONDAY = "DATE'1970-01-05'"
_SECONDS = {"second": 1, "minute": 60, "hour": 3600}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_div(x: Column | str, step: Column | int) -> Column:
    """Integer division that rounds down, for negative numbers too."""
    x, step = _col(x).cast("long"), (F.lit(step) if isinstance(step, int) else step).cast("long")
    return F.call_function("div", x - F.pmod(x, step), step)


#: No index of a time reaches this, from any year that a time can have.
_BEYOND = 10**15


def _time_div(x: Column, step: int) -> Column:
    """``floor_div`` of an index of time, which names ``x`` only once: nested roundings stay short."""
    shift = -(-_BEYOND // step)
    return F.call_function("div", x.cast("long") + F.lit(shift * step).cast("long"), F.lit(step).cast("long")) - shift


def unit_index(ts: Column | str, unit: str) -> Column:
    """Whole units since 1970-01-01 (weeks since Monday 1970-01-05)."""
    ts = _col(ts)
    days = F.datediff(F.to_date(ts), F.expr(_EPOCH)).cast("long")
    if unit in _SECONDS:
        within = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
        return _time_div(days * 86400 + within, _SECONDS[unit])
    if unit == "day":
        return days
    if unit == "week":
        return _time_div(F.datediff(F.to_date(ts), F.expr(_FIRST_MONDAY)), 7)
    months = ((F.year(ts) - 1970) * 12 + F.month(ts) - 1).cast("long")
    return _time_div(months, _MONTHS[unit])


def unit_start(index: Column | str, unit: str) -> Column:
    """The first instant of a unit, as time without zone."""
    index = _col(index).cast("long")
    epoch = F.expr(_EPOCH)
    if unit in _SECONDS:
        seconds = index * _SECONDS[unit]
        day = F.date_add(epoch, _time_div(seconds, 86400).cast("int"))
        return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod(seconds, F.lit(86400)).cast("decimal(18,6)"))
    if unit == "day":
        day = F.date_add(epoch, index.cast("int"))
    elif unit == "week":
        day = F.date_add(F.expr(_FIRST_MONDAY), (index * 7).cast("int"))
    else:
        day = F.add_months(epoch, (index * _MONTHS[unit]).cast("int"))
    return day.cast("timestamp_ntz")


def floor_to(ts: Column | str, unit: str, step: int = 1) -> Column:
    """The start of the group of ``step`` units that holds ``ts``."""
    return unit_start(_time_div(unit_index(ts, unit), step) * step, unit)


def ceil_to(ts: Column | str, unit: str, step: int = 1) -> Column:
    """The first start of such a group that is not before ``ts``."""
    below = floor_to(ts, unit, step)
    return F.when(below == _col(ts), below).otherwise(unit_start((_time_div(unit_index(ts, unit), step) + 1) * step, unit))


def add_units(ts: Column | str, n: int, unit: str) -> Column:
    """``ts`` moved by n units; months keep the day, or the last day that there is."""
    ts = _col(ts)
    if unit in _MONTHS:
        return ts + F.make_ym_interval(F.lit(0), F.lit(n * _MONTHS[unit]))
    seconds = n * (_SECONDS.get(unit) or {"day": 86400, "week": 7 * 86400}[unit])
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))


def hex_prefix(x: Column | str) -> Column:
    """The first eight hex digits of a text or UUID, as a number."""
    return F.conv(F.substring(_col(x), 1, 8), 16, 10).cast("long")


def bucket(d: Dimension) -> Column:
    """The bucket id of a row in one dimension; for values, the value itself."""
    if d.kind == "int":
        return floor_div(F.col(d.column).cast("long") - d.offset, d.step)
    if d.kind == "hex":
        return floor_div(hex_prefix(d.column), d.step)
    if d.kind == "value":
        return F.col(d.column)
    return _time_div(unit_index(d.column, d.unit), d.step)


def partition_id(dims: list[Dimension], outer: list[Dimension] = ()) -> Column:
    """Ids of several dimensions joined by hyphens, after those of the enclosing partition."""
    return F.concat_ws("-", *[bucket(d).cast("string") for d in (*outer, *dims)])


def bounds(d: Dimension, id_: Column | str) -> tuple[Column, Column]:
    """Start (inside) and end (outside) of a bucket."""
    i = _col(id_).cast("long")
    if d.kind == "int":
        return i * d.step + d.offset, (i + 1) * d.step + d.offset
    if d.kind == "hex":
        return F.lpad(F.lower(F.hex(i * d.step)), 8, "0"), F.lpad(F.lower(F.hex((i + 1) * d.step)), 8, "0")
    if d.kind == "value":
        return _col(id_), _col(id_)
    start, end = unit_start(i * d.step, d.unit), unit_start((i + 1) * d.step, d.unit)
    return (start.cast("date"), end.cast("date")) if d.kind == "date" else (start, end)


def boundary(d: Dimension) -> tuple[Column, Column]:
    """Start and end of the bucket that holds a row's value."""
    return bounds(d, bucket(d))
