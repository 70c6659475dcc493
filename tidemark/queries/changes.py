"""Hashes and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import hashing as H
from tidemark.functions.buckets import floor_div
from tidemark.operators import diff as D
from tidemark.operators import tree
from tidemark.operators.digests import block_digests
from tidemark.queries.registry import BLOCKS_SQL, HASHED, PAIR_SQL, dst, hash_sql, query, src, table, text_sql
from tidemark.queries.scans import _ROWS_SQL
from tidemark.spec import Dimension
from tidemark.work import folder

BY_100 = [Dimension("id", 100)]
_O = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"]


@query(f"SELECT o_orderkey, md5({text_sql(_O)}) AS row_hash, md5(coalesce(CAST(o_custkey AS VARCHAR), '') || coalesce(CAST(o_orderkey AS VARCHAR), '')) AS compatible_hash FROM orders")
def row_hash_md5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", H.row_hash(_O).alias("row_hash"), H.row_hash(["o_orderkey", "o_custkey"], compatible=True).alias("compatible_hash"))


@query(f"SELECT o_orderkey, {hash_sql(_O)} AS row_hash FROM orders")
def row_hash_int(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", H.row_hash_int(_O).alias("row_hash"))


_PIPED = "concat_ws('|', coalesce(CAST(o_orderkey AS VARCHAR), ''), coalesce(CAST(o_custkey AS VARCHAR), ''), coalesce(o_orderstatus, ''))"


@query(f"SELECT o_orderkey, md5({_PIPED}) AS row_hash FROM orders")
def row_hash_piped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.md5(H.row_text(_O[:3], "|", "")).alias("row_hash"))


@query(f"SELECT o_orderkey // 100 AS block, md5(string_agg({_PIPED}, '|' ORDER BY o_orderkey)) AS block_hash FROM orders GROUP BY 1")
def block_hash_piped(spark: SparkSession, d: str) -> DataFrame:
    return block_digests(table(spark, d, "orders"), floor_div("o_orderkey", 100), H.row_text(_O[:3], "|", ""), ["o_orderkey"], "|", "block_hash").select("block", "block_hash")


@query(f"SELECT CAST(o_orderkey // 100 AS VARCHAR) AS partition_id, count(*) AS num_rows, CAST(sum({hash_sql(_O)}) AS BIGINT) AS hash FROM orders GROUP BY 1")
def partition_hash(spark: SparkSession, d: str) -> DataFrame:
    return D.bucket_hashes(table(spark, d, "orders"), [Dimension("o_orderkey", 100)], _O)


@query(f"SELECT o_orderkey // 100 AS block, md5(string_agg(left(md5({text_sql(_O)}), 8), '' ORDER BY o_orderkey)) AS block_hash FROM orders GROUP BY 1")
def partition_hash_ordered(spark: SparkSession, d: str) -> DataFrame:
    digests = block_digests(table(spark, d, "orders"), floor_div("o_orderkey", 100), F.left(H.row_hash(_O), F.lit(8)), ["o_orderkey"], name="block_hash")
    return digests.select("block", "block_hash")


@query(f"SELECT o_custkey, count(*) AS n, CAST(sum({hash_sql(_O)}) AS BIGINT) AS group_hash FROM orders GROUP BY 1")
def group_hash(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.aggregate import grouped

    return grouped(table(spark, d, "orders"), {"o_custkey": "o_custkey"}, {"n": "count(*)"}, _O)


@query(f"WITH t AS (SELECT o_orderkey, {hash_sql(_O)} AS h FROM orders) SELECT CAST(o_orderkey // 500 AS VARCHAR) AS partition_id, count(*) AS num_rows, CAST(sum(h) AS BIGINT) AS hash FROM t GROUP BY 1")
def hash_stored_column(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "orders").select("o_orderkey", H.row_hash_int(_O).alias("checksum"))
    return D.bucket_hashes(stored, [Dimension("o_orderkey", 500)], stored="checksum")


def _diff(spark: SparkSession, d: str, skip: bool = False) -> DataFrame:
    return D.bucket_diff(D.bucket_hashes(src(spark, d), BY_100, HASHED), D.bucket_hashes(dst(spark, d), BY_100, HASHED), skip)


@query(f"{BLOCKS_SQL} SELECT * FROM diff")
def partition_diff(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d)


@query(f"{BLOCKS_SQL} SELECT * FROM diff")
def partition_diff_hash_only(spark: SparkSession, d: str) -> DataFrame:
    """Counts are not compared; sums of hashes of different counts differ here as well."""
    return _diff(spark, d, True)


@query(f"{BLOCKS_SQL} SELECT status, count(*) AS partitions, CAST(sum(num_rows) AS BIGINT) AS num_rows FROM diff GROUP BY 1")
def partition_diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return D.summary(_diff(spark, d))


_FULL_SQL = f"""{_ROWS_SQL}, full_rows AS (
  SELECT st.id, st.change_type, CASE WHEN st.change_type = 'D' THEN d.cust_id ELSE s.cust_id END AS cust_id, CASE WHEN st.change_type = 'D' THEN d.status ELSE s.status END AS status,
         CASE WHEN st.change_type = 'D' THEN d.updated_at ELSE s.updated_at END AS updated_at, d.cust_id AS old_cust_id, d.status AS old_status
  FROM st LEFT JOIN src s ON s.id = st.id LEFT JOIN dst d ON d.id = st.id
)"""
_CHANGED = "SELECT id, cust_id, status, updated_at, change_type FROM full_rows WHERE change_type <> 'N'"


@query(f"{_FULL_SQL} {_CHANGED}")
def row_diff(spark: SparkSession, d: str) -> DataFrame:
    return D.row_diff(src(spark, d), dst(spark, d), ["id"], HASHED)


@query(f"{_FULL_SQL} SELECT id, status, change_type, old_cust_id, old_status FROM full_rows WHERE change_type <> 'N'")
def row_diff_old(spark: SparkSession, d: str) -> DataFrame:
    rows = D.row_diff(src(spark, d), dst(spark, d), ["id"], HASHED, old=True)
    return rows.select("id", "status", "change_type", F.col("old__.cust_id").alias("old_cust_id"), F.col("old__.status").alias("old_status"))


@query(f"{_ROWS_SQL} SELECT id, change_type FROM st")
def row_status(spark: SparkSession, d: str) -> DataFrame:
    return D.row_status(src(spark, d), dst(spark, d), ["id"], HASHED).select("id", "change_type")


@query(f"WITH {PAIR_SQL} SELECT coalesce(s.id, d.id) AS id, CASE WHEN d.id IS NULL THEN 'A' ELSE 'D' END AS change_type FROM src s FULL JOIN dst d ON s.id = d.id WHERE s.id IS NULL OR d.id IS NULL")
def row_diff_selective(spark: SparkSession, d: str) -> DataFrame:
    """status is not hashed, so rows that differ in it alone are no changes."""
    return D.row_diff(src(spark, d), dst(spark, d), ["id"], ["id", "cust_id", "updated_at"]).select("id", "change_type")


@query(f"{_FULL_SQL} {_CHANGED}")
def hash_sync_changes(spark: SparkSession, d: str) -> DataFrame:
    return D.hash_changes(src(spark, d), dst(spark, d), BY_100, ["id"], HASHED)


@query(
    f"""{_FULL_SQL.replace("WITH", BLOCKS_SQL.rstrip() + ",", 1).replace(PAIR_SQL + ", st", " st")}
    SELECT f.id, f.cust_id, f.status, f.updated_at, CASE WHEN p.status = 'M' AND p.count_diff >= 0 AND f.change_type <> 'D' THEN 'M' ELSE f.change_type END AS change_type
    FROM full_rows f JOIN diff p ON p.partition_id = CAST(f.id // 100 AS VARCHAR)
    WHERE p.status <> 'N' AND (f.change_type <> 'N' OR p.status = 'M' AND p.count_diff >= 0)"""
)
def hash_sync_refresh(spark: SparkSession, d: str) -> DataFrame:
    return D.hash_changes(src(spark, d), dst(spark, d), BY_100, ["id"], HASHED, refresh=True)


#: Orders by blocks of customers: every third order of the source has moved to another customer's block.
_MOVED = "(o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 40 ELSE 0 END)"
_MOVED_SQL = f"""
WITH s AS (SELECT o_orderkey AS id, {_MOVED} AS cust_id, o_orderstatus AS status FROM orders WHERE o_custkey // 20 % 3 = 1 AND o_orderkey % 8 <> 5),
d AS (SELECT o_orderkey AS id, o_custkey AS cust_id, o_orderstatus AS status FROM orders WHERE o_custkey // 20 % 3 = 1 AND o_orderkey % 8 <> 6),
h AS (
  SELECT coalesce(s.b, d.b) AS b, s.b IS NOT NULL AND d.b IS NULL AS is_new, coalesce(s.n, 0) - coalesce(d.n, 0) AS more, s.n IS DISTINCT FROM d.n OR s.h IS DISTINCT FROM d.h AS differs
  FROM (SELECT cust_id // 20 AS b, count(*) AS n, sum({hash_sql(["id", "cust_id", "status"])}) AS h FROM s GROUP BY 1) s
  FULL JOIN (SELECT cust_id // 20 AS b, count(*) AS n, sum({hash_sql(["id", "cust_id", "status"])}) AS h FROM d GROUP BY 1) d ON s.b = d.b
), sb AS (SELECT s.*, is_new, more FROM s JOIN h ON cust_id // 20 = b WHERE differs), db AS (SELECT d.* FROM d JOIN h ON cust_id // 20 = b WHERE differs)
"""


@query(f"""{_MOVED_SQL} SELECT * FROM (
  SELECT coalesce(sb.id, db.id) AS id, CASE WHEN sb.id IS NULL THEN db.cust_id ELSE sb.cust_id END AS cust_id, CASE WHEN sb.id IS NULL THEN db.status ELSE sb.status END AS status,
         CASE WHEN sb.id IS NULL THEN 'D' WHEN is_new AND db.id IS NULL THEN 'A' WHEN is_new OR more >= 0 THEN 'M' WHEN db.id IS NULL THEN 'A' WHEN sb.cust_id <> db.cust_id OR sb.status <> db.status THEN 'M' END AS change_type
  FROM sb FULL JOIN db ON sb.id = db.id) WHERE change_type IS NOT NULL""")
def hash_sync_refresh_moved(spark: SparkSession, d: str) -> DataFrame:
    """Rows that moved to another bucket are one change each."""
    orders = table(spark, d, "orders").where("o_custkey div 20 % 3 = 1")
    s = orders.where("o_orderkey % 8 <> 5").selectExpr("o_orderkey AS id", f"{_MOVED} AS cust_id", "o_orderstatus AS status")
    t = orders.where("o_orderkey % 8 <> 6").selectExpr("o_orderkey AS id", "o_custkey AS cust_id", "o_orderstatus AS status")
    return D.hash_changes(s, t, [Dimension("cust_id", 20)], ["id"], ["id", "cust_id", "status"], refresh=True)


@query(f"WITH {PAIR_SQL} SELECT id FROM dst WHERE id NOT IN (SELECT id FROM src)")
def orphan_deletes(spark: SparkSession, d: str) -> DataFrame:
    return D.orphans(src(spark, d), dst(spark, d), ["id"])


@query(f"WITH {PAIR_SQL} SELECT id FROM src WHERE id NOT IN (SELECT id FROM dst)")
def keys_only_in_source(spark: SparkSession, d: str) -> DataFrame:
    return D.orphans(dst(spark, d), src(spark, d), ["id"])


@query(f"WITH {PAIR_SQL} SELECT id FROM dst WHERE id NOT IN (SELECT id FROM src)")
def keys_only_in_dest(spark: SparkSession, d: str) -> DataFrame:
    return D.orphans(src(spark, d), dst(spark, d), ["id"])


@query(f"WITH {PAIR_SQL} SELECT id FROM src WHERE id IN (SELECT id FROM dst)")
def keys_in_both(spark: SparkSession, d: str) -> DataFrame:
    return src(spark, d).select("id").join(dst(spark, d).select("id"), "id", "left_semi")


def _level_sql(name: str, id_: str, where: str) -> str:
    side = lambda t: f"SELECT {id_} AS partition_id, count(*) AS n, CAST(sum({hash_sql(HASHED)}) AS BIGINT) AS h FROM {t} {where} GROUP BY 1"
    return f"""{name} AS (
      SELECT coalesce(s.partition_id, d.partition_id) AS partition_id,
             CASE WHEN d.partition_id IS NULL THEN 'A' WHEN s.partition_id IS NULL THEN 'D' WHEN s.h = d.h AND s.n = d.n THEN 'N' ELSE 'M' END AS status,
             greatest(coalesce(s.n, 0), coalesce(d.n, 0)) AS num_rows, coalesce(s.n, 0) - coalesce(d.n, 0) AS count_diff
      FROM ({side('src')}) s FULL JOIN ({side('dst')}) d ON s.partition_id = d.partition_id)"""


_TOP, _SUB = "CAST(id // 1000 AS VARCHAR)", "CAST(id // 1000 AS VARCHAR) || '-' || CAST(id // 100 AS VARCHAR)"


_DRILL_SQL = (
    f"""WITH {PAIR_SQL}, {_level_sql('l0', _TOP, '')}, big AS (SELECT partition_id FROM l0 WHERE status IN ('A', 'M') AND num_rows > 500),
    {_level_sql('l1', _SUB, f'WHERE {_TOP} IN (SELECT partition_id FROM big)')}
    SELECT *, 0 AS level FROM l0 WHERE partition_id NOT IN (SELECT partition_id FROM big) UNION ALL SELECT *, 1 AS level FROM l1"""
)


@query(_DRILL_SQL)
def partition_diff_drill(spark: SparkSession, d: str) -> DataFrame:
    return D.drill(src(spark, d), dst(spark, d), [[Dimension("id", 1000)], BY_100], HASHED, 500)


@query(_DRILL_SQL)
def hash_tree_drill(spark: SparkSession, d: str) -> DataFrame:
    """The same from trees of hashes that are kept: the source's was built before 1997 and is renewed."""
    levels, s, path = [[Dimension("id", 1000)], BY_100], src(spark, d), folder(spark)
    tree.renew(s.where("updated_at < TIMESTAMP_NTZ'1997-01-01'"), path, levels, HASHED, "updated_at")
    return tree.drill_tree(tree.renew(s, path, levels, HASHED, "updated_at"), tree.leaves(dst(spark, d), levels, HASHED, digits=15), 2, 500)


@query(f"{_FULL_SQL} {_CHANGED}")
def hash_sync_drill(spark: SparkSession, d: str) -> DataFrame:
    return D.drill_changes(src(spark, d), dst(spark, d), [[Dimension("id", 1000)], BY_100], ["id"], HASHED, 500)
