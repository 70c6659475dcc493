"""Casts and transforms of columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.casting import cast, cast_to_schema
from tidemark.functions.transforms import named, transform_chain
from tidemark.queries.registry import query, table


def _raw(options: list[str | None]) -> str:
    """A column that takes the given literals in turn by the order's key."""
    cases = " ".join(f"WHEN {i} THEN {'NULL' if o is None else repr(o)}" for i, o in enumerate(options))
    return f"CASE CAST(o_orderkey % {len(options)} AS INTEGER) {cases} END"


def _rows(spark: SparkSession, d: str, options: list[str | None]) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey", f"{_raw(options)} AS raw")


def _casts(spark: SparkSession, d: str, options: list[str | None], kinds: dict[str, str]) -> DataFrame:
    return _rows(spark, d, options).select("o_orderkey", *[cast("raw", k).alias(n) for n, k in kinds.items()])


def _with_raw(options: list[str | None], columns: str) -> str:
    return f"WITH t AS (SELECT o_orderkey, {_raw(options)} AS raw FROM orders) SELECT o_orderkey, {columns} FROM t"


_NUMBERS = ["42", "3.9", "-7", "abc", "", None, " 12 ", "99999", "3000000000", "0.125", "-0.5"]
_WHOLE = "trunc(TRY_CAST(trim(raw) AS DECIMAL(28,10)))"


@query(
    _with_raw(
        _NUMBERS,
        f"TRY_CAST({_WHOLE} AS INTEGER) AS as_integer, TRY_CAST({_WHOLE} AS BIGINT) AS as_bigint, TRY_CAST({_WHOLE} AS SMALLINT) AS as_smallint, "
        "TRY_CAST(trim(raw) AS FLOAT) AS as_float, TRY_CAST(trim(raw) AS DOUBLE) AS as_double, TRY_CAST(trim(raw) AS DECIMAL(18,4)) AS as_decimal",
    )
)
def cast_numeric(spark: SparkSession, d: str) -> DataFrame:
    out = _rows(spark, d, _NUMBERS)
    kinds = ("integer", "bigint", "smallint", "float", "double")
    return out.select("o_orderkey", *[cast("raw", k).alias(f"as_{k}") for k in kinds], cast("raw", "decimal", (18, 4)).alias("as_decimal"))


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS as_text, CAST(o_orderdate AS VARCHAR) AS as_varchar, CAST(o_orderstatus AS VARCHAR) AS as_char FROM orders")
def cast_string(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", cast("o_custkey", "text").alias("as_text"), cast("o_orderdate", "varchar").alias("as_varchar"), cast("o_orderstatus", "char").alias("as_char"))


_DAYS = ["2024-01-15", "2024-02-30", "2023-12-31 23:59:59", "15.01.2024", None, "12:30:45", "25:00:00", "00:00:00", "2024-06-01T10:00:00"]


@query(
    _with_raw(
        _DAYS,
        "CASE WHEN regexp_matches(raw, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(left(raw, 10) AS DATE) END AS as_date, "
        "CASE WHEN regexp_matches(raw, '^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$') THEN raw END AS as_time",
    )
)
def cast_date_time(spark: SparkSession, d: str) -> DataFrame:
    return _casts(spark, d, _DAYS, {"as_date": "date", "as_time": "time"})


_TIMES = ["2024-01-15 10:20:30", "2024-01-15T10:20:30", "2024-01-15 10:20:30.123456", "2024-01-15", "1700000000", "1700000000.5", "soon", None, "2024-01-15T10:20:30Z", "2024-01-15 10:20:30+02:00"]
_BARE = "regexp_replace(raw, '(:[0-9]{2}(\\.[0-9]+)?)(Z|[+-][0-9]{2}:?[0-9]{2})$', '\\1')"
_EPOCH = "CASE WHEN regexp_matches(raw, '^[+-]?[0-9]+(\\.[0-9]+)?$') THEN TIMESTAMP '1970-01-01' + to_microseconds(CAST(CAST(raw AS DOUBLE) * 1000000 AS BIGINT)) END"
_PARSED = f"CASE WHEN regexp_matches({_BARE}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[ T]') THEN TRY_CAST({_BARE} AS TIMESTAMP) END"


@query(_with_raw(_TIMES, f"coalesce({_PARSED}, {_EPOCH}) AS as_timestamp, coalesce({_PARSED}, CASE WHEN regexp_matches(raw, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST(raw AS TIMESTAMP) END, {_EPOCH}) AS as_datetime"))
def cast_timestamp_formats(spark: SparkSession, d: str) -> DataFrame:
    return _casts(spark, d, _TIMES, {"as_timestamp": "timestamp", "as_datetime": "datetime"})


_WORDS = ["true", "False", "1", "0", "YES", "no", "on", "Off", "maybe", None, ""]


@query(_with_raw(_WORDS, "CASE WHEN lower(raw) IN ('true', '1', 'yes', 'on') THEN true WHEN lower(raw) IN ('false', '0', 'no', 'off') THEN false END AS as_boolean"))
def cast_boolean_words(spark: SparkSession, d: str) -> DataFrame:
    return _casts(spark, d, _WORDS, {"as_boolean": "boolean"})


@query("SELECT o_orderkey, lower(hex(encode(o_orderpriority))) AS as_hex FROM orders")
def cast_binary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.lower(F.hex(cast("o_orderpriority", "binary"))).alias("as_hex"))


_JSON = ['{"a": 1, "b": "x"}', "[1, 2]", "{bad", None, '{"a": {"c": 7}}', "12"]


@query(_with_raw(_JSON, "CASE WHEN json_valid(raw) THEN raw END AS as_json, CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.a.c') END AS c"))
def cast_json(spark: SparkSession, d: str) -> DataFrame:
    rows = _casts(spark, d, _JSON, {"as_json": "json"})
    return rows.withColumn("c", F.get_json_object("as_json", "$.a.c"))


_MD5 = "md5(CAST(o_orderkey AS {s}))"
_FORM = "CASE CAST(o_orderkey % 4 AS INTEGER) WHEN 0 THEN {m} WHEN 1 THEN upper({m}) WHEN 2 THEN {m5} ELSE left({m}, 30) END"
_DASHED = "concat_ws('-', substr({m}, 1, 8), substr({m}, 9, 4), substr({m}, 13, 4), substr({m}, 17, 4), substr({m}, 21, 12))"


def _uuids(string: str) -> str:
    m = _MD5.format(s=string)
    return _FORM.format(m=m, m5=_DASHED.format(m=m))


_OK = f"CASE WHEN o_orderkey % 4 <> 3 THEN {_MD5.format(s='VARCHAR')} END"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN {_DASHED.format(m=_MD5.format(s='VARCHAR'))} END AS as_uuid, {_OK} AS as_uuid_text FROM orders")
def cast_uuid_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("o_orderkey", f"{_uuids('STRING')} AS raw")
    return rows.select("o_orderkey", cast("raw", "uuid").alias("as_uuid"), cast("raw", "uuid_text").alias("as_uuid_text"))


@query(
    f"""WITH t AS (SELECT o_orderkey, {_raw(_NUMBERS)} AS amount, {_raw(_WORDS)} AS flag, o_orderstatus AS other FROM orders), c AS (
      SELECT o_orderkey, amount AS a0, flag AS f0, other, CAST(trunc(TRY_CAST(trim(amount) AS DECIMAL(28,10))) AS BIGINT) AS amount,
             CASE WHEN lower(flag) IN ('true', '1', 'yes', 'on') THEN true WHEN lower(flag) IN ('false', '0', 'no', 'off') THEN false END AS flag FROM t
    ) SELECT o_orderkey, amount, flag, other, concat_ws(',', CASE WHEN a0 IS NOT NULL AND amount IS NULL THEN 'amount' END, CASE WHEN f0 IS NOT NULL AND flag IS NULL THEN 'flag' END) AS errors FROM c"""
)
def cast_to_schema_(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("o_orderkey", f"{_raw(_NUMBERS)} AS amount", f"{_raw(_WORDS)} AS flag", "o_orderstatus AS other")
    done = cast_to_schema(rows, {"amount": "bigint", "flag": "boolean"})
    return done.withColumn("errors", F.concat_ws(",", "_cast_errors")).drop("_cast_errors")


@query(
    """SELECT event_id, coalesce(CAST(user_id AS VARCHAR), '') AS user_text, CAST(ts AS DATE) AS day, lower(event_type) AS low, upper(event_type) AS up,
    trim('  ' || event_type || ' ') AS bare, length(event_type) AS n, TRY_CAST(CASE WHEN event_id % 2 = 0 THEN '17' ELSE 'x' END AS BIGINT) AS whole, TRY_CAST(CASE WHEN event_id % 2 = 0 THEN '2.5' ELSE 'x' END AS DOUBLE) AS fraction FROM events"""
)
def named_transforms(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumns({
        "padded": F.expr("concat('  ', event_type, ' ')"), "int_": F.expr("CASE WHEN event_id % 2 = 0 THEN '17' ELSE 'x' END"), "float_": F.expr("CASE WHEN event_id % 2 = 0 THEN '2.5' ELSE 'x' END"),
    })
    chosen = {"user_text": ("to_str", "user_id"), "day": ("datetime_to_date", "ts"), "low": ("lowercase", "event_type"), "up": ("uppercase", "event_type"), "bare": ("strip", "padded"), "n": ("length", "event_type"), "whole": ("to_int", "int_"), "fraction": ("to_float", "float_")}
    return e.select("event_id", *[named(f, c).alias(n) for n, (f, c) in chosen.items()])


_STATUS = "CASE WHEN event_id % 5 = 0 THEN 'D' ELSE 'M' END"


@query(f"SELECT event_id, {_STATUS} AS change_type, CASE WHEN event_id % 5 <> 0 THEN user_id * 2 END AS twice, CASE WHEN event_id % 5 <> 0 THEN user_id * 2 + event_id END AS total, CASE WHEN event_id % 5 <> 0 THEN event_type || '-' || CAST(user_id * 2 AS VARCHAR) END AS label FROM events")
def transform_chain_(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").selectExpr("event_id", "user_id", "event_type", f"{_STATUS} AS change_type")
    steps = [("twice", "user_id * 2"), ("total", lambda df: F.col("twice") + F.col("event_id")), ("label", "concat(event_type, '-', twice)")]
    return transform_chain(rows, steps, "change_type").select("event_id", "change_type", "twice", "total", "label")


@query("SELECT event_id, user_id * 3 + 1 AS scaled FROM events")
def transform_pandas_udf(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("long")
    def scale(x: pd.Series) -> pd.Series:
        return x * 3 + 1

    return transform_chain(table(spark, d, "events"), [("scaled", scale(F.col("user_id")))]).select("event_id", "scaled")


@query("SELECT event_type, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1")
def transform_custom_step(spark: SparkSession, d: str) -> DataFrame:
    def even_users(df: DataFrame, modulus: int) -> DataFrame:
        return df.where(F.col("user_id") % modulus == 0)

    return table(spark, d, "events").transform(even_users, 2).groupBy("event_type").agg(F.count("*").alias("n"))
