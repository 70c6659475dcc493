"""Scans, sinks, projections and filters."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.buckets import partition_id
from tidemark.operators import predicates as P
from tidemark.operators.aggregate import column_limits, watermark
from tidemark.operators.diff import row_diff
from tidemark.queries.registry import HASHED, PAIR_SQL, dst, hash_sql, query, src, table
from tidemark.sources import database, readers, writers
from tidemark.spec import ColumnSpec, Dimension, TableSpec
from tidemark.work import folder

ORDERS = TableSpec(
    (
        ColumnSpec("id", "o_orderkey", "bigint", key=True, order="asc"),
        ColumnSpec("cust_id", "o_custkey", "bigint"),
        ColumnSpec("status", "o_orderstatus", "text"),
        ColumnSpec("cents", "CAST(round(o_totalprice * 100) AS BIGINT)", "bigint", hashed=False),
        ColumnSpec("checksum", "md5(o_orderstatus)", "text", virtual=True),
    ),
    ("o_orderstatus <> 'P'",),
)


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


_SPEC_SQL = "SELECT o_orderkey AS id, o_custkey AS cust_id, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderstatus <> 'P'"


@query(f"SELECT *, CAST(id // 100 AS VARCHAR) AS partition_id FROM ({_SPEC_SQL}) WHERE id >= 200 AND id < 1200")
def scan_partition(spark: SparkSession, d: str) -> DataFrame:
    rows = ORDERS.fetch(orders(spark, d)).where(P.half_open("id", 200, 1200))
    return rows.withColumn("partition_id", partition_id([Dimension("id", 100)]))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_orderdate AS day FROM orders")
def scan_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).selectExpr("o_orderkey AS id", "o_orderstatus AS status", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority", "o_orderdate AS day")
    writers.write_csv(rows, path := folder(spark))
    return readers.read_csv(spark, path, "id bigint, status string, priority string, day timestamp_ntz")


@query("SELECT c_custkey, c_nationkey FROM customer")
def scan_parquet(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_parquet(spark, f"{d}/customer.parquet").select("c_custkey", "c_nationkey")


_LOG = "event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 'ERROR' ELSE 'INFO' END AS level, event_type AS message"


@query(f"SELECT * FROM (SELECT {_LOG} FROM events WHERE event_id % 7 <> 0) WHERE level = 'ERROR' ORDER BY seq DESC LIMIT 100")
def scan_jsonl_tail(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh line is malformed and skipped."""
    good = table(spark, d, "events").selectExpr(*[f"{x}" for x in ("event_id AS seq", "CASE WHEN event_id % 4 = 0 THEN 'ERROR' ELSE 'INFO' END AS level", "event_type AS message")])
    line = F.when(F.col("seq") % 7 == 0, F.concat(F.lit('{"seq": '), F.col("seq").cast("string"))).otherwise(F.to_json(F.struct("seq", "level", "message")))
    good.select(line.alias("value")).write.text(path := folder(spark))
    return readers.tail(readers.read_jsonl(spark, path, "seq bigint, level string, message string"), "error", "seq", 100)


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 250 OFFSET 500")
def page_scan(spark: SparkSession, d: str) -> DataFrame:
    return readers.page(orders(spark, d).select("o_orderkey", "o_custkey", "o_orderdate"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 500, 250)


@query("SELECT (SELECT count(*) FROM orders) > 0 AS any_orders, (SELECT count(*) FROM orders WHERE o_orderkey < 0) > 0 AS any_negative")
def has_data_probe(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    flags = [F.lit(readers.has_data(x)).alias(n) for n, x in (("any_orders", o), ("any_negative", o.where("o_orderkey < 0")))]
    return o.select(*flags).limit(1)


_CHG = "SELECT * FROM src WHERE id % 3 = 0"
_UPSERT = f"WITH {PAIR_SQL}, chg AS ({_CHG}) SELECT * FROM dst WHERE id NOT IN (SELECT id FROM chg) UNION ALL SELECT * FROM chg"


@query(_UPSERT)
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    return writers.upsert(dst(spark, d), src(spark, d).where("id % 3 = 0"), ["id"])


@query(_UPSERT)
def upsert_delete_insert(spark: SparkSession, d: str) -> DataFrame:
    return writers.delete_insert(dst(spark, d), src(spark, d).where("id % 3 = 0"), ["id"])


@query(f"WITH {PAIR_SQL} SELECT * FROM dst UNION ALL SELECT src.* FROM src WHERE id NOT IN (SELECT id FROM dst)")
def append_insert(spark: SparkSession, d: str) -> DataFrame:
    old, new = dst(spark, d), src(spark, d)
    return writers.append(old, new.join(old.select("id"), "id", "left_anti"))


@query(f"WITH {PAIR_SQL} SELECT * FROM dst WHERE NOT (id >= 1000 AND id < 3000 AND status <> 'P')")
def delete_by_partition(spark: SparkSession, d: str) -> DataFrame:
    return writers.delete_where(dst(spark, d), P.half_open("id", 1000, 3000) & P.compare("status", "!=", "P"))


@query(f"WITH {PAIR_SQL} SELECT * FROM dst WHERE id IN (SELECT id FROM src)")
def delete_by_keys(spark: SparkSession, d: str) -> DataFrame:
    gone = dst(spark, d).join(src(spark, d), "id", "left_anti")
    return writers.delete_by_keys(dst(spark, d), gone, ["id"])


@query("SELECT event_id, user_id, event_type, ts FROM events")
def write_jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
    writers.write_jsonl(rows, path := folder(spark))
    back = readers.read_jsonl(spark, path, "event_id bigint, user_id bigint, event_type string, ts string")
    return back.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_BAD = "CASE WHEN o_orderkey % 10 = 3 THEN 'x' || o_orderkey ELSE CAST(o_custkey AS VARCHAR(20)) END"
_QUARANTINE_SQL = f"""
WITH raw AS (
  SELECT o_orderkey AS id, {_BAD} AS cust_id, CASE WHEN o_orderkey % 10 = 7 THEN NULL ELSE o_orderstatus END AS status, CAST(o_orderkey // 100 AS VARCHAR) AS partition_id FROM orders
), flagged AS (
  SELECT *, (cust_id IS NOT NULL AND TRY_CAST(cust_id AS BIGINT) IS NULL) OR status IS NULL AS bad FROM raw
)"""


def _raw(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    raw = orders(spark, d).selectExpr(
        "o_orderkey AS id", "CASE WHEN o_orderkey % 10 = 3 THEN concat('x', o_orderkey) ELSE CAST(o_custkey AS STRING) END AS cust_id",
        "CASE WHEN o_orderkey % 10 = 7 THEN NULL ELSE o_orderstatus END AS status", "CAST(o_orderkey div 100 AS STRING) AS partition_id",
    )
    return writers.quarantine(raw, (ColumnSpec("id", data_type="bigint"), ColumnSpec("cust_id", data_type="bigint"), ColumnSpec("status", nullable=False)))


@query(f"{_QUARANTINE_SQL} SELECT id, TRY_CAST(cust_id AS BIGINT) AS cust_id, status, bad AS rejected FROM flagged")
def write_quarantine(spark: SparkSession, d: str) -> DataFrame:
    good, bad = _raw(spark, d)
    return good.select("id", "cust_id", "status", F.lit(False).alias("rejected")).unionByName(bad.select("id", "cust_id", "status", F.lit(True).alias("rejected")))


@query(f"{_QUARANTINE_SQL} SELECT DISTINCT partition_id FROM flagged WHERE bad")
def failed_partitions(spark: SparkSession, d: str) -> DataFrame:
    return writers.failed_partitions(_raw(spark, d)[1])


_TARGET = "CREATE TABLE target (id INTEGER PRIMARY KEY, cust_id INTEGER NOT NULL, priority TEXT CONSTRAINT short CHECK (length(priority) < 14), cents INTEGER CONSTRAINT cheap CHECK (cents < 30000000))"
_REFUSED_SQL = """
WITH raw AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 <> 5 THEN o_custkey END AS cust_id, o_orderpriority AS priority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders
), told AS (
  SELECT *, CASE WHEN cust_id IS NULL THEN 'NOT NULL constraint failed: target.cust_id' WHEN length(priority) >= 14 THEN 'CHECK constraint failed: short'
                 WHEN cents >= 30000000 THEN 'CHECK constraint failed: cheap' WHEN id % 50 = 0 THEN 'UNIQUE constraint failed: target.id' END AS error__ FROM raw
)"""


def _refused(spark: SparkSession, d: str) -> tuple[DataFrame, Callable[[], sqlite3.Connection], DataFrame]:
    """A table of a database that has every 50th order already; the orders that it refuses, all orders."""
    path = folder(spark).removeprefix("file://").removeprefix("file:")
    connect = partial(sqlite3.connect, f"{path}.db", timeout=600, autocommit=False)
    rows = orders(spark, d).selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 13 <> 5 THEN o_custkey END AS cust_id", "o_orderpriority AS priority", "CAST(round(o_totalprice * 100) AS BIGINT) AS cents")
    first = connect()
    first.execute(_TARGET)
    first.commit()
    first.close()
    database.insert_rows(rows.where("id % 50 = 0").selectExpr("id", "-1 AS cust_id", "'-' AS priority", "-1 AS cents"), connect, "target")
    return database.insert_rows(rows, connect, "target"), connect, rows


@query(f"{_REFUSED_SQL} SELECT * FROM told WHERE error__ IS NOT NULL")
def write_refused_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a database's constraints refuse, with its messages."""
    return _refused(spark, d)[0]


@query(f"{_REFUSED_SQL} SELECT id, cust_id, priority, cents FROM told WHERE error__ IS NULL UNION ALL SELECT id, -1, '-', -1 FROM raw WHERE id % 50 = 0")
def write_accepted_rows(spark: SparkSession, d: str) -> DataFrame:
    """What the table holds afterwards, read in ranges of its key."""
    _, connect, rows = _refused(spark, d)
    lo, hi = rows.agg(F.min("id"), F.max("id")).first()
    step = max(1, (hi - lo) // 8 + 1)
    cells = [f"SELECT id, cust_id, priority, cents FROM target WHERE id >= {a} AND id < {a + step}" for a in range(lo, hi + 1, step)]
    return database.read_rows(spark, connect, cells, "id bigint, cust_id bigint, priority string, cents bigint")


@query(f"WITH {PAIR_SQL} SELECT * FROM src")
def apply_changes(spark: SparkSession, d: str) -> DataFrame:
    s, t = src(spark, d), dst(spark, d)
    return writers.apply_changes(t, row_diff(s, t, ["id"], HASHED), ["id"])


_ROWS_SQL = f"""
WITH {PAIR_SQL}, st AS (
  SELECT coalesce(s.id, d.id) AS id, CASE WHEN d.id IS NULL THEN 'A' WHEN s.id IS NULL THEN 'D' WHEN {hash_sql([f's.{c}' for c in HASHED])} = {hash_sql([f'd.{c}' for c in HASHED])} THEN 'N' ELSE 'M' END AS change_type
  FROM src s FULL JOIN dst d ON s.id = d.id
)"""


@query(f"{_ROWS_SQL} SELECT change_type, count(*) AS num_rows FROM st WHERE change_type <> 'N' GROUP BY 1")
def change_counters(spark: SparkSession, d: str) -> DataFrame:
    return writers.change_counters(row_diff(src(spark, d), dst(spark, d), ["id"], HASHED))


@query(f"{_ROWS_SQL} SELECT change_type, count(*) AS num_rows, true AS all_small FROM st WHERE change_type <> 'N' GROUP BY 1")
def write_sized_files(spark: SparkSession, d: str) -> DataFrame:
    """Rows per change type as read back, and whether no file has more than 500."""
    writers.write_sized(row_diff(src(spark, d), dst(spark, d), ["id"], HASHED), path := folder(spark), 500)
    files = spark.read.parquet(path).groupBy("change_type", F.col("_metadata.file_name").alias("file_name")).agg(F.count("*").alias("n"))
    return files.groupBy("change_type").agg(F.sum("n").alias("num_rows"), (F.max("n") <= 500).alias("all_small"))


@query(f"{_ROWS_SQL} SELECT change_type, count(*) AS num_rows, CAST(ceil(count(*) / 300) AS BIGINT) AS files, true AS full_enough FROM st WHERE change_type <> 'N' GROUP BY 1")
def write_joined_files(spark: SparkSession, d: str) -> DataFrame:
    """Files per change type, from many small batches of changes, and whether they are between half full and full."""
    changes = row_diff(src(spark, d), dst(spark, d), ["id"], HASHED).repartition(23)
    writers.write_sized(changes, path := folder(spark), 300)
    files = spark.read.parquet(path).groupBy("change_type", F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    full = (F.max("n") <= 300) & ((F.min("n") >= 150) | (F.count("*") == 1))
    return files.groupBy("change_type").agg(F.sum("n").alias("num_rows"), F.count("*").alias("files"), full.alias("full_enough"))


@query(_SPEC_SQL)
def project_columns(spark: SparkSession, d: str) -> DataFrame:
    return ORDERS.fetch(orders(spark, d))


@query("SELECT o_orderkey AS id, o_custkey AS cust_id, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders")
def project_no_virtual(spark: SparkSession, d: str) -> DataFrame:
    return TableSpec(ORDERS.columns).fetch(orders(spark, d))


@query("SELECT o_orderkey AS order_id, o_custkey AS cust_id, o_orderstatus AS state, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderstatus <> 'P'")
def project_rename(spark: SparkSession, d: str) -> DataFrame:
    return ORDERS.renamed(ORDERS.fetch(orders(spark, d)), {"id": "order_id", "status": "state"})


_O = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE"


def _o(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus")


@query(f"{_O} o_custkey > 100 AND o_custkey <= 900 AND o_orderstatus <> 'F' AND o_orderpriority LIKE '1%'")
def filter_compare(spark: SparkSession, d: str) -> DataFrame:
    c = P.compare("o_custkey", ">", 100) & P.compare("o_custkey", "<=", 900) & P.compare("o_orderstatus", "!=", "F") & P.compare("o_orderpriority", "like", "1%")
    return orders(spark, d).where(c).select("o_orderkey", "o_custkey", "o_orderstatus")


@query(f"{_O} o_custkey IN (1, 5, 9, 42, 77) OR o_orderkey = 12")
def filter_in(spark: SparkSession, d: str) -> DataFrame:
    return _o(spark, d).where(P.compare("o_custkey", "in", [1, 5, 9, 42, 77]) | P.compare("o_custkey", "in", []) | P.compare("o_orderkey", "in", 12))


@query(f"{_O} o_orderstatus NOT IN ('F', 'P')")
def filter_not_in(spark: SparkSession, d: str) -> DataFrame:
    return _o(spark, d).where(P.compare("o_orderstatus", "not in", ["F", "P"]) & P.compare("o_custkey", "not in", []))


@query(f"{_O} (o_custkey, o_orderstatus) IN ((1, 'F'), (2, 'O'), (5, 'F'), (7, 'O'), (10, 'F'), (11, 'P'))")
def filter_tuple_in(spark: SparkSession, d: str) -> DataFrame:
    return P.in_tuples(_o(spark, d), ["o_custkey", "o_orderstatus"], [(1, "F"), (2, "O"), (5, "F"), (7, "O"), (10, "F"), (11, "P")])


@query(f"{_O} (o_custkey > 50 OR o_custkey = 50 AND o_orderkey >= 3000) AND (o_custkey < 60 OR o_custkey = 60 AND o_orderkey < 9000)")
def filter_tuple_range(spark: SparkSession, d: str) -> DataFrame:
    return P.tuple_range(_o(spark, d), ["o_custkey", "o_orderkey"], (50, 3000), (60, 9000))


@query(f"{_O} o_orderkey >= 100 AND o_orderkey < 9000 AND o_custkey IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 20, 30) AND o_orderstatus IN ('F', 'O')")
def filter_mixed(spark: SparkSession, d: str) -> DataFrame:
    return P.mixed(_o(spark, d), {"o_orderkey": (100, 9000)}, {"o_custkey": [*range(1, 11), 20, 30], "o_orderstatus": ["F", "O"]})


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def filter_half_open(spark: SparkSession, d: str) -> DataFrame:
    lit = lambda s: F.lit(s).cast("timestamp_ntz")
    return orders(spark, d).where(P.half_open("o_orderdate", lit("1995-01-01"), lit("1996-01-01"))).select("o_orderkey", "o_orderdate")


@query(f"{_O} o_orderkey >= 500 AND o_orderkey < 2500 AND o_orderstatus IN ('O', 'F')")
def filter_user_bounds(spark: SparkSession, d: str) -> DataFrame:
    return P.user_bounds(_o(spark, d), [{"column": "o_orderkey", "start": 500, "end": 2500}, {"column": "o_orderstatus", "value": ["O", "F"]}])


@query("SELECT min(o_orderkey) AS min_o_orderkey, max(o_orderkey) AS max_o_orderkey, min(o_orderdate) AS min_o_orderdate, max(o_orderdate) AS max_o_orderdate FROM orders")
def bounds_min_max(spark: SparkSession, d: str) -> DataFrame:
    return column_limits(orders(spark, d), ["o_orderkey", "o_orderdate"])


@query("SELECT max(ts) AS watermark FROM events")
def watermark_max(spark: SparkSession, d: str) -> DataFrame:
    return watermark(table(spark, d, "events"), "ts")

