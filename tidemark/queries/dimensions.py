"""Buckets, grids, affected keys and bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import buckets as B
from tidemark.operators import aggregate as A
from tidemark.operators import grids as G
from tidemark.plans.bounds import resolve_bounds
from tidemark.queries.registry import query, table
from tidemark.spec import UNITS, Dimension


@query("SELECT o_orderkey, CAST(floor((o_orderkey - 5000) / 700.0) AS BIGINT) AS bucket, CAST(floor((o_orderkey - 333) / 100.0) AS BIGINT) AS moved FROM orders")
def bucket_int(spark: SparkSession, d: str) -> DataFrame:
    """Keys below the offset fall in negative buckets, rounded down."""
    return table(spark, d, "orders").select("o_orderkey", B.floor_div(F.col("o_orderkey") - 5000, 700).alias("bucket"), B.bucket(Dimension("o_orderkey", 100, offset=333)).alias("moved"))


_INDEX = {
    "second": "CAST(floor(epoch({c})) AS BIGINT)", "minute": "CAST(floor(epoch({c}) / 60) AS BIGINT)", "hour": "CAST(floor(epoch({c}) / 3600) AS BIGINT)",
    "day": "CAST(CAST({c} AS DATE) - DATE '1970-01-01' AS BIGINT)", "week": "CAST(floor((CAST({c} AS DATE) - DATE '1970-01-05') / 7.0) AS BIGINT)",
    "month": "CAST((year({c}) - 1970) * 12 + month({c}) - 1 AS BIGINT)", "quarter": "CAST((year({c}) - 1970) * 4 + quarter({c}) - 1 AS BIGINT)", "year": "CAST(year({c}) - 1970 AS BIGINT)",
}
_START = {
    "second": "(TIMESTAMP '1970-01-01' + to_seconds({i}))", "minute": "(TIMESTAMP '1970-01-01' + to_minutes({i}))", "hour": "(TIMESTAMP '1970-01-01' + to_hours({i}))",
    "day": "(TIMESTAMP '1970-01-01' + to_days(CAST({i} AS INT)))", "week": "(TIMESTAMP '1970-01-05' + to_days(CAST({i} * 7 AS INT)))",
    "month": "(TIMESTAMP '1970-01-01' + to_months(CAST({i} AS INT)))", "quarter": "(TIMESTAMP '1970-01-01' + to_months(CAST({i} * 3 AS INT)))", "year": "(TIMESTAMP '1970-01-01' + to_years(CAST({i} AS INT)))",
}


def _index(column: str, unit: str) -> str:
    return _INDEX[unit].format(c=column)


def _start(index: str, unit: str) -> str:
    return _START[unit].format(i=index)


@query("SELECT event_id, " + ", ".join(f"{_index('ts', u)} // 3 AS {u}_bucket" for u in UNITS) + " FROM events")
def bucket_datetime_units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", *[B.bucket(Dimension("ts", 3, "datetime", u)).alias(f"{u}_bucket") for u in UNITS])


@query("SELECT o_orderkey, " + ", ".join(f"{_index('o_orderdate', u)} // 2 AS {u}_bucket" for u in UNITS[3:]) + " FROM orders")
def bucket_date_units(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return rows.select("o_orderkey", *[B.bucket(Dimension("day", 2, "date", u)).alias(f"{u}_bucket") for u in UNITS[3:]])


@query("SELECT o_orderkey, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) // 90000000 AS bucket FROM orders")
def bucket_hex(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string")).alias("uid"))
    return rows.select("o_orderkey", B.bucket(Dimension("uid", 90_000_000, "hex")).alias("bucket"))


@query("SELECT o_custkey, (row_number() OVER (ORDER BY o_custkey) - 1) // 25 AS chunk FROM (SELECT DISTINCT o_custkey FROM orders)")
def bucket_values(spark: SparkSession, d: str) -> DataFrame:
    return A.affected_values(table(spark, d, "orders"), [Dimension("o_custkey", 25, "value")])


def _key_limits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").agg((F.min("o_orderkey") + 150).alias("lo"), (F.max("o_orderkey") + 1).alias("hi"))


_KEYS = "(SELECT min(o_orderkey) + 150 AS lo, max(o_orderkey) + 1 AS hi FROM orders)"
_CELLS = "unnest(generate_series({a}, {b}))"


@query(f"SELECT cell AS partition_id, cell * 400 AS start_, (cell + 1) * 400 AS end_ FROM (SELECT {_CELLS.format(a='lo // 400', b='(hi - 1) // 400')} AS cell FROM {_KEYS})")
def grid_int_aligned(spark: SparkSession, d: str) -> DataFrame:
    return G.int_grid(_key_limits(spark, d), 400)


@query(f"SELECT cell AS partition_id, lo + cell * 400 AS start_, least(lo + (cell + 1) * 400, hi) AS end_ FROM (SELECT *, {_CELLS.format(a='0', b='(hi - lo - 1) // 400')} AS cell FROM {_KEYS})")
def grid_int_bounded(spark: SparkSession, d: str) -> DataFrame:
    return G.int_grid(_key_limits(spark, d), 400, bounded=True)


def _time_limits(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))


def _grid_sql(unit: str, step: int, limits: str, kind: str) -> str:
    last = f"CASE WHEN {_start(f'({_index('hi', unit)} // {step} * {step})', unit)} = hi THEN {_index('hi', unit)} // {step} - 1 ELSE {_index('hi', unit)} // {step} END"
    cells = f"SELECT *, {_CELLS.format(a=f'{_index('lo', unit)} // {step}', b=last)} AS cell FROM {limits}"
    start, end = _start(f"(cell * {step})", unit), _start(f"((cell + 1) * {step})", unit)
    return f"SELECT '{unit}' AS unit, cell AS partition_id, CAST({start} AS {kind}) AS start_, CAST({end} AS {kind}) AS end_, CAST(greatest({start}, lo) AS {kind}) AS cut_start, CAST(least({end}, hi) AS {kind}) AS cut_end FROM ({cells})"


#: Steps that give tens to hundreds of cells over the events and orders.
_EVENT_STEPS = {"second": 43200, "minute": 1440, "hour": 24, "day": 2, "week": 1, "month": 1, "quarter": 1, "year": 1}
_ORDER_STEPS = {"day": 30, "week": 5, "month": 2, "quarter": 1, "year": 2}


def _grids(limits: DataFrame, steps: dict[str, int], date: bool) -> DataFrame:
    out = None
    for unit, step in steps.items():
        cells = G.datetime_cells(limits, step, unit, date).select(F.lit(unit).alias("unit"), "*")
        out = cells if out is None else out.unionByName(cells)
    return out


@query(" UNION ALL ".join(_grid_sql(u, s, "(SELECT min(ts) AS lo, max(ts) AS hi FROM events)", "TIMESTAMP") for u, s in _EVENT_STEPS.items()))
def grid_datetime(spark: SparkSession, d: str) -> DataFrame:
    return _grids(_time_limits(table(spark, d, "events"), "ts"), _EVENT_STEPS, False)


@query(" UNION ALL ".join(_grid_sql(u, s, "(SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders)", "DATE") for u, s in _ORDER_STEPS.items()))
def grid_date(spark: SparkSession, d: str) -> DataFrame:
    return _grids(_time_limits(table(spark, d, "orders"), "o_orderdate"), _ORDER_STEPS, True)


_UUID = "SELECT min(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT)) AS lo, max(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT)) AS hi FROM orders"


def _dashed(prefix: str, fill: str) -> str:
    return f"({prefix} || '-{fill * 4}-{fill * 4}-{fill * 4}-{fill * 12}')"


@query(
    f"""SELECT cell AS partition_id, {_dashed("lpad(lower(to_hex(cell * 300000000)), 8, '0')", '0')} AS start_,
    CASE WHEN (cell + 1) * 300000000 >= 4294967296 THEN {_dashed("'ffffffff'", 'f')} ELSE {_dashed("lpad(lower(to_hex((cell + 1) * 300000000)), 8, '0')", '0')} END AS end_,
    (cell + 1) * 300000000 >= 4294967296 AS last_
    FROM (SELECT {_CELLS.format(a='lo // 300000000', b='hi // 300000000')} AS cell FROM ({_UUID}))"""
)
def grid_uuid(spark: SparkSession, d: str) -> DataFrame:
    prefix = B.hex_prefix(F.md5(F.col("o_orderkey").cast("string")))
    return G.uuid_grid(table(spark, d, "orders").agg(F.min(prefix).alias("lo"), F.max(prefix).alias("hi")), 300_000_000)


_K = f"(SELECT {_CELLS.format(a='lo // 4000', b='(hi - 1) // 4000')} AS k FROM {_KEYS})"
_Y = f"(SELECT {_CELLS.format(a='(year(lo) - 1970) // 2', b='(year(hi) - 1970) // 2')} AS y FROM (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders))"


@query(f"SELECT k AS key_id, k * 4000 AS key_start, (k + 1) * 4000 AS key_end, y AS year_id, {_start('(y * 2)', 'year')} AS year_start, {_start('((y + 1) * 2)', 'year')} AS year_end, k || '-' || y AS partition_id FROM {_K}, {_Y}")
def grid_multi(spark: SparkSession, d: str) -> DataFrame:
    years = G.datetime_grid(_time_limits(table(spark, d, "orders"), "o_orderdate"), 2, "year")
    return G.product({"key": G.int_grid(_key_limits(spark, d), 4000), "year": years})


@query(
    f"""WITH parents AS (SELECT cell AS partition_id, lo + cell * 1000 AS start_, least(lo + (cell + 1) * 1000, hi) AS end_ FROM (SELECT *, {_CELLS.format(a='0', b='(hi - lo - 1) // 1000')} AS cell FROM {_KEYS}))
    SELECT partition_id || '-' || child AS partition_id, partition_id AS parent_id, greatest(child * 300, start_) AS start_, least((child + 1) * 300, end_) AS end_
    FROM (SELECT *, {_CELLS.format(a='start_ // 300', b='(end_ - 1) // 300')} AS child FROM parents)"""
)
def grid_child(spark: SparkSession, d: str) -> DataFrame:
    return G.children(G.int_grid(_key_limits(spark, d), 1000, bounded=True), 300)


@query(f"SELECT DISTINCT {_index('ts', 'hour')} // 6 AS partition_id, {_start(f'({_index('ts', 'hour')} // 6 * 6)', 'hour')} AS start_, {_start(f'(({_index('ts', 'hour')} // 6 + 1) * 6)', 'hour')} AS end_ FROM events")
def bucket_bounds(spark: SparkSession, d: str) -> DataFrame:
    dim = Dimension("ts", 6, "datetime", "hour")
    return G.bucket_bounds(table(spark, d, "events").select(B.bucket(dim).alias("partition_id")).distinct(), dim)


_WEEK = f"{_index('o_orderdate', 'week')} // 2 * 2"


@query(f"SELECT o_orderkey, o_orderkey // 250 * 250 AS key_start, (o_orderkey // 250 + 1) * 250 AS key_end, {_start(f'({_WEEK})', 'week')} AS week_start, {_start(f'({_WEEK} + 2)', 'week')} AS week_end FROM orders")
def value_boundary(spark: SparkSession, d: str) -> DataFrame:
    (a, b), (w, x) = B.boundary(Dimension("o_orderkey", 250)), B.boundary(Dimension("o_orderdate", 2, "datetime", "week"))
    return table(spark, d, "orders").select("o_orderkey", a.alias("key_start"), b.alias("key_end"), w.alias("week_start"), x.alias("week_end"))


def _changed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))


_CHG = "(SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')"


@query(f"SELECT o_custkey // 10 * 10 AS o_custkey_start, (o_custkey // 10 + 1) * 10 AS o_custkey_end, {_start(_index('o_orderdate', 'month'), 'month')} AS o_orderdate_start, {_start(f'({_index('o_orderdate', 'month')} + 1)', 'month')} AS o_orderdate_end, count(*) AS num_rows FROM {_CHG} GROUP BY 1, 2, 3, 4")
def affected_ranges(spark: SparkSession, d: str) -> DataFrame:
    return A.affected_ranges(_changed(spark, d), [Dimension("o_custkey", 10), Dimension("o_orderdate", 1, "datetime", "month")])


@query(f"SELECT *, (row_number() OVER (ORDER BY o_custkey, o_orderstatus) - 1) // 50 AS chunk FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM {_CHG})")
def affected_values(spark: SparkSession, d: str) -> DataFrame:
    return A.affected_values(_changed(spark, d), [Dimension("o_custkey", 50, "value"), Dimension("o_orderstatus", 200, "value")])


@query(f"SELECT *, (row_number() OVER (PARTITION BY o_orderkey_start ORDER BY o_custkey) - 1) // 20 AS chunk FROM (SELECT DISTINCT o_orderkey // 2000 * 2000 AS o_orderkey_start, (o_orderkey // 2000 + 1) * 2000 AS o_orderkey_end, o_custkey FROM {_CHG})")
def affected_mixed(spark: SparkSession, d: str) -> DataFrame:
    return A.affected_mixed(_changed(spark, d), [Dimension("o_orderkey", 2000)], [Dimension("o_custkey", 20, "value")])


_S = "SELECT * FROM (SELECT min(s.o_orderkey) AS lo, max(s.o_orderkey) AS hi FROM orders s WHERE o_orderkey >= 100)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    return o.where("o_orderkey >= 100"), o.where("o_orderkey < 900")


@query(_S)
def resolve_bounds_full(spark: SparkSession, d: str) -> DataFrame:
    return resolve_bounds(*_sides(spark, d), "o_orderkey", "full")


@query("SELECT (SELECT max(o_orderkey) FROM orders WHERE o_orderkey < 900) AS lo, (SELECT max(o_orderkey) FROM orders) AS hi")
def resolve_bounds_delta(spark: SparkSession, d: str) -> DataFrame:
    return resolve_bounds(*_sides(spark, d), "o_orderkey", "delta")


@query("SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
def resolve_bounds_hash(spark: SparkSession, d: str) -> DataFrame:
    return resolve_bounds(*_sides(spark, d), "o_orderkey", "hash")


@query("SELECT event_id, " + ", ".join(f"{_start(_index('ts', u), u)} AS {u}_floor, CASE WHEN {_start(_index('ts', u), u)} = ts THEN ts ELSE {_start(f'({_index('ts', u)} + 1)', u)} END AS {u}_ceil" for u in UNITS) + " FROM events")
def floor_ceil_units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", *[f("ts", u).alias(f"{u}_{n}") for u in UNITS for f, n in ((B.floor_to, "floor"), (B.ceil_to, "ceil"))])


_ADD = {"second": "to_seconds(5)", "minute": "to_minutes(5)", "hour": "to_hours(5)", "day": "to_days(5)", "week": "to_days(35)", "month": "to_months(5)", "quarter": "to_months(15)", "year": "to_years(5)"}


@query("SELECT event_id, " + ", ".join(f"{_start(f'({_index('ts', u)} // 3 * 3)', u)} AS {u}_aligned, ts + {_ADD[u]} AS {u}_moved" for u in UNITS) + " FROM events")
def align_add_units(spark: SparkSession, d: str) -> DataFrame:
    columns = [c for u in UNITS for c in (B.floor_to("ts", u, 3).alias(f"{u}_aligned"), B.add_units("ts", 5, u).alias(f"{u}_moved"))]
    return table(spark, d, "events").select("event_id", *columns)

