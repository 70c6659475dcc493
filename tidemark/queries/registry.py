"""Queries with their equivalents in SQL, and the derived tables that several of them read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with SQL that gives the same rows (none: rows only)."""

    def register(f: Query) -> Query:
        name = f.__name__.rstrip("_")  # a trailing underscore keeps clear of the operator's own name
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The columns of src and dst that are hashed.
HASHED = ["id", "cust_id", "status", "updated_at"]
_BLOCK = "(o_orderkey div 100) % 10"


def src(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(f"NOT ({_BLOCK} = 4 AND o_orderkey % 100 = 50) AND {_BLOCK} <> 5")
    return o.selectExpr("o_orderkey AS id", "o_custkey AS cust_id", "o_orderstatus AS status", "o_orderdate AS updated_at")


def dst(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(f"{_BLOCK} <> 1 AND NOT ({_BLOCK} = 3 AND o_orderkey % 11 = 0)")
    status = f"CASE WHEN {_BLOCK} = 2 AND o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status"
    return o.selectExpr("o_orderkey AS id", "o_custkey AS cust_id", status, "o_orderdate AS updated_at")


PAIR_SQL = """
src AS (
  SELECT o_orderkey AS id, o_custkey AS cust_id, o_orderstatus AS status, o_orderdate AS updated_at FROM orders
  WHERE NOT ((o_orderkey // 100) % 10 = 4 AND o_orderkey % 100 = 50) AND (o_orderkey // 100) % 10 <> 5
), dst AS (
  SELECT o_orderkey AS id, o_custkey AS cust_id,
         CASE WHEN (o_orderkey // 100) % 10 = 2 AND o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status,
         o_orderdate AS updated_at
  FROM orders WHERE (o_orderkey // 100) % 10 <> 1 AND NOT ((o_orderkey // 100) % 10 = 3 AND o_orderkey % 11 = 0)
)"""


def text_sql(columns: list[str]) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in sorted(columns)) + ")"


def hash_sql(columns: list[str]) -> str:
    """The integer row hash."""
    return f"CAST('0x' || substr(md5({text_sql(columns)}), 1, 8) AS BIGINT)"


#: Hashes of the blocks of 100 keys on both sides, and their diff.
BLOCKS_SQL = f"""
WITH {PAIR_SQL}, s AS (
  SELECT CAST(id // 100 AS VARCHAR) AS partition_id, count(*) AS n, CAST(sum({hash_sql(HASHED)}) AS BIGINT) AS h FROM src GROUP BY 1
), d AS (
  SELECT CAST(id // 100 AS VARCHAR) AS partition_id, count(*) AS n, CAST(sum({hash_sql(HASHED)}) AS BIGINT) AS h FROM dst GROUP BY 1
), diff AS (
  SELECT coalesce(s.partition_id, d.partition_id) AS partition_id,
         CASE WHEN d.partition_id IS NULL THEN 'A' WHEN s.partition_id IS NULL THEN 'D' WHEN s.h = d.h AND s.n = d.n THEN 'N' ELSE 'M' END AS status,
         greatest(coalesce(s.n, 0), coalesce(d.n, 0)) AS num_rows, coalesce(s.n, 0) - coalesce(d.n, 0) AS count_diff
  FROM s FULL JOIN d ON s.partition_id = d.partition_id
)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")


def scd(spark: SparkSession, sf_dir: str, ahead: int = 1) -> DataFrame:
    """Purchases as intervals of validity per user; they overlap where ``ahead`` is above 1."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return bought.select("user_id", F.col("ts").alias("valid_from"), F.lead("ts", ahead).over(w).alias("valid_to"), F.col("event_id").alias("dim_id"), F.col("value").alias("tier_value"))


def scd_sql(ahead: int = 1) -> str:
    return f"""scd AS (
  SELECT user_id, ts AS valid_from, lead(ts, {ahead}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to, event_id AS dim_id, value AS tier_value
  FROM events WHERE event_type = 'purchase'
)"""
