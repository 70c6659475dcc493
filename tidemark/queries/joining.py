"""Joins, lookups, as-of and validity joins, dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.operators.dedup import keep_last, newest
from tidemark.queries.registry import events, query, scd, scd_sql, table

#: Keys are shifted, so that some customers have no orders and some orders no customer.
_CO = "SELECT c.c_custkey, o.o_orderkey FROM customer c {how} JOIN orders o ON c.c_custkey = o.o_custkey + 10"


def _joined(spark: SparkSession, d: str, how: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return J.chain(c, [(o, c["c_custkey"] == o["o_custkey"] + 10, how)]).select("c_custkey", "o_orderkey")


@query(_CO.format(how="INNER"))
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d, "inner")


@query(_CO.format(how="LEFT"))
def join_left(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d, "left")


@query(_CO.format(how="RIGHT"))
def join_right(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d, "right")


@query(_CO.format(how="FULL"))
def join_full(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d, "full_outer")


@query("SELECT o_orderkey, c_custkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join_chain(spark: SparkSession, d: str) -> DataFrame:
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    joined = J.chain(o, [(c, o["o_custkey"] == c["c_custkey"], "inner"), (n, c["c_nationkey"] == n["n_nationkey"], "left"), (r, n["n_regionkey"] == r["r_regionkey"], "left")])
    return joined.select("o_orderkey", "c_custkey", "n_name", "r_name")


_FIRST = "(SELECT o_custkey + 10 AS o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1)"


def _firsts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("o_custkey", F.col("o_custkey") + 10)



@query(f"SELECT c_custkey, c_nationkey, o_orderkey, o_orderdate FROM customer LEFT JOIN {_FIRST} o ON c_custkey = o_custkey")
def lookup_left_one(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return J.lookup(c, _firsts(spark, d), {"c_custkey": "o_custkey"}, order=[F.col("o_orderdate"), F.col("o_orderkey")], fetch={"o_orderkey": "o_orderkey", "o_orderdate": "o_orderdate"})


@query(f"SELECT c_custkey, c_nationkey, o_orderkey FROM customer JOIN {_FIRST} o ON c_custkey = o_custkey")
def lookup_inner_one(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return J.lookup(c, _firsts(spark, d), {"c_custkey": "o_custkey"}, "inner", order=[F.col("o_orderdate"), F.col("o_orderkey")], fetch={"o_orderkey": "o_orderkey"})


@query("SELECT c_custkey, c_nationkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def lookup_left_many(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "orders")
    return J.lookup(c, o.select("o_custkey", "o_orderkey", "o_orderstatus"), {"c_custkey": "o_custkey"}, many=True)


@query("SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def lookup_inner_many(spark: SparkSession, d: str) -> DataFrame:
    o, l = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return J.lookup(o, l, {"o_orderkey": "l_orderkey"}, "inner", many=True)


@query("SELECT o_orderkey, o_custkey, c_nationkey AS nation, c_name AS customer FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_fetch_alias(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer")
    return J.lookup(o, c, {"o_custkey": "c_custkey"}, order=[F.col("c_name")], fetch={"c_nationkey": "nation", "c_name": "customer"})


_RECENT = "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01'"


@query(f"SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM ({_RECENT}))")
def lookup_fetch_only(spark: SparkSession, d: str) -> DataFrame:
    recent = table(spark, d, "orders").where("o_orderdate >= TIMESTAMP_NTZ'1997-06-01'")
    return J.lookup_rows(recent, table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), {"o_custkey": "c_custkey"})


@query(f"SELECT o_orderkey, o_custkey, c_name FROM ({_RECENT}) LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_semi_reduce(spark: SparkSession, d: str) -> DataFrame:
    recent = table(spark, d, "orders").where("o_orderdate >= TIMESTAMP_NTZ'1997-06-01'").select("o_orderkey", "o_custkey")
    dim = J.lookup_rows(recent, table(spark, d, "customer").select("c_custkey", "c_name"), {"o_custkey": "c_custkey"})
    return J.lookup(recent, dim, {"o_custkey": "c_custkey"}, order=[F.col("c_name")])


@query("SELECT o_orderkey, o_custkey, upper(c_name) AS customer, length(c_name) AS name_length, CAST(c_nationkey AS VARCHAR) AS nation FROM orders LEFT JOIN (SELECT c_custkey + 10 AS c_custkey, c_name, c_nationkey FROM customer) ON o_custkey = c_custkey")
def enrich_dimension(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").withColumn("c_custkey", F.col("c_custkey") + 10)
    fields = {"customer": "upper(c_name)", "name_length": "length(c_name)", "nation": "CAST(c_nationkey AS STRING)"}
    return J.enrich(o, c, {"o_custkey": "c_custkey"}, fields, [F.col("customer")])


def _asof_sql(operator: str) -> str:
    direction = "DESC" if operator[0] == "<" else "ASC"
    return f"""WITH {scd_sql()} SELECT e.event_id, e.user_id, s.dim_id, s.tier_value FROM events e LEFT JOIN scd s ON e.user_id = s.user_id AND s.valid_from {operator} e.ts
    QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY s.valid_from {direction}, s.dim_id {direction}) = 1"""


_FETCH = {"dim_id": "dim_id", "tier_value": "tier_value"}


def _asof(spark: SparkSession, d: str, operator: str) -> DataFrame:
    return J.asof(events(spark, d), scd(spark, d), ["user_id"], "ts", "valid_from", operator, _FETCH, "dim_id").select("event_id", "user_id", "dim_id", "tier_value")


@query(_asof_sql("<="))
def asof_le(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, "<=")


@query(_asof_sql("<"))
def asof_lt(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, "<")


@query(_asof_sql(">="))
def asof_ge(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, ">=")


@query(_asof_sql(">"))
def asof_gt(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, ">")


@query(_asof_sql("<="))
def asof_pruned(spark: SparkSession, d: str) -> DataFrame:
    return J.asof_pruned(events(spark, d), scd(spark, d), ["user_id"], "ts", "valid_from", _FETCH, "dim_id").select("event_id", "user_id", "dim_id", "tier_value")


def _sliced(spark: SparkSession, d: str, operator: str) -> DataFrame:
    found = J.asof(events(spark, d), scd(spark, d), ["user_id"], "ts", "valid_from", operator, _FETCH, "dim_id", slices=(1, "day"))
    return found.select("event_id", "user_id", "dim_id", "tier_value")


@query(_asof_sql("<="))
def asof_sliced(spark: SparkSession, d: str) -> DataFrame:
    """Keys divided by days."""
    return _sliced(spark, d, "<=")


@query(_asof_sql(">"))
def asof_sliced_after(spark: SparkSession, d: str) -> DataFrame:
    return _sliced(spark, d, ">")


@query(
    """SELECT e.event_id, e.user_id, e.event_type, b.event_id AS before_id FROM events e LEFT JOIN events b
    ON e.user_id = b.user_id AND e.event_type = b.event_type AND b.ts < e.ts QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY b.ts DESC, b.event_id DESC) = 1"""
)
def asof_multi_key(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    dim = e.select("user_id", "event_type", F.col("ts").alias("at"), F.col("event_id").alias("before_id"))
    return J.asof(e, dim, ["user_id", "event_type"], "ts", "at", "<", {"before_id": "before_id"}, "before_id").select("event_id", "user_id", "event_type", "before_id")


def _scd_sql(on: str, ahead: int = 1) -> str:
    return f"""WITH {scd_sql(ahead)} SELECT e.event_id, e.user_id, s.dim_id, s.tier_value FROM events e LEFT JOIN scd s ON e.user_id = s.user_id AND {on}
    QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY s.valid_from DESC, s.dim_id DESC) = 1"""


def _scd(spark: SparkSession, d: str, ahead: int = 1, **options: object) -> DataFrame:
    found = J.scd(events(spark, d), scd(spark, d, ahead), ["user_id"], "ts", "valid_from", "valid_to", fetch=_FETCH, tie="dim_id", **options)
    return found.select("event_id", "user_id", "dim_id", "tier_value")


@query(_scd_sql("s.valid_from <= e.ts AND (s.valid_to IS NULL OR e.ts < s.valid_to)"))
def scd_join(spark: SparkSession, d: str) -> DataFrame:
    return _scd(spark, d, overlapping=False)


@query(_scd_sql("s.valid_from <= e.ts AND e.ts < s.valid_to"))
def scd_join_closed_only(spark: SparkSession, d: str) -> DataFrame:
    return _scd(spark, d, open_ended=False, overlapping=False, check=True)


@query(_scd_sql("s.valid_from <= e.ts AND (s.valid_to IS NULL OR e.ts < s.valid_to)", 2))
def scd_overlap_latest(spark: SparkSession, d: str) -> DataFrame:
    return _scd(spark, d, 2)


@query(_scd_sql("s.valid_from >= e.ts AND (s.valid_to IS NULL OR e.ts < s.valid_to)"))
def scd_join_reverse(spark: SparkSession, d: str) -> DataFrame:
    return _scd(spark, d, operator=">=")


@query("SELECT event_id, user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def dedup_last(spark: SparkSession, d: str) -> DataFrame:
    return keep_last(events(spark, d), ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT event_id, user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 20")
def keep_latest_n(spark: SparkSession, d: str) -> DataFrame:
    return newest(events(spark, d), ["event_type"], [F.desc("ts"), F.desc("event_id")], 20)
