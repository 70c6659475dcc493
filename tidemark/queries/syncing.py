"""Strategies end to end, aggregates, schema evolution, streaming, ledger and run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import increments
from tidemark.operators.aggregate import grouped
from tidemark.operators.diff import bucket_hashes, row_diff
from tidemark.operators.schema import evolve
from tidemark.plans import audit, resume
from tidemark.plans import strategies as S
from tidemark.queries.changes import _CHANGED, _FULL_SQL, BY_100
from tidemark.queries.registry import HASHED, PAIR_SQL, dst, hash_sql, query, src, table
from tidemark.queries.scans import _ROWS_SQL
from tidemark.sources import versioned
from tidemark.sources.writers import apply_changes, upsert
from tidemark.spec import Dimension
from tidemark.streaming.upserts import latest, start_upsert
from tidemark.work import folder, saved

_CUT = "TIMESTAMP '1997-01-01'"


@query(f"WITH {PAIR_SQL} SELECT *, 'A' AS change_type FROM src")
def sync_full(spark: SparkSession, d: str) -> DataFrame:
    return S.full(src(spark, d))


def _old(spark: SparkSession, d: str) -> DataFrame:
    """The destination as it was at the cut-off."""
    return dst(spark, d).where("updated_at < TIMESTAMP_NTZ'1997-01-01'")


_DELTA = f"WITH {PAIR_SQL}, new AS (SELECT * FROM src WHERE updated_at >= (SELECT max(updated_at) FROM dst WHERE updated_at < {_CUT}))"


@query(f"{_DELTA} SELECT * FROM dst WHERE updated_at < {_CUT} AND id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new")
def sync_delta_rows(spark: SparkSession, d: str) -> DataFrame:
    old = _old(spark, d)
    return upsert(old, S.delta(src(spark, d), old, "updated_at").drop("change_type"), ["id"])


@query(
    f"""{_DELTA} SELECT n.*, CASE WHEN o.id IS NULL THEN 'A' ELSE 'M' END AS change_type FROM new n LEFT JOIN (SELECT * FROM dst WHERE updated_at < {_CUT}) o ON n.id = o.id
    WHERE o.id IS NULL OR {hash_sql([f'n.{c}' for c in HASHED])} <> {hash_sql([f'o.{c}' for c in HASHED])}"""
)
def sync_delta_changed_only(spark: SparkSession, d: str) -> DataFrame:
    return S.delta_changed(src(spark, d), _old(spark, d), "updated_at", ["id"], HASHED)


@query(f"WITH {PAIR_SQL} SELECT *, 'A' AS change_type FROM src")
def sync_auto_empty_dst(spark: SparkSession, d: str) -> DataFrame:
    return S.auto(src(spark, d), dst(spark, d).where("id < 0"), BY_100, ["id"], HASHED, "updated_at")


@query(f"{_FULL_SQL} {_CHANGED}")
def sync_auto_nonempty_dst(spark: SparkSession, d: str) -> DataFrame:
    return S.auto(src(spark, d), dst(spark, d), BY_100, ["id"], HASHED, "updated_at", wish="full")


@query(f"WITH {PAIR_SQL} SELECT * FROM src")
def sync_hash_apply(spark: SparkSession, d: str) -> DataFrame:
    s, t = src(spark, d), dst(spark, d)
    return apply_changes(t, S.hash_changes(s, t, BY_100, ["id"], HASHED), ["id"])


_KEYS = {"cust_id": "o_custkey", "day": "CAST(o_orderdate AS DATE)"}
_AGGREGATES = {
    "num_orders": "count(*)", "total": "sum(CAST(o_totalprice AS DECIMAL(18,2)))", "smallest": "min(o_orderkey)", "largest": "max(o_orderkey)",
    "mean_key": "avg(o_orderkey)", "last_updated_at": "max(o_orderdate)",
}
_HASHED = ["o_orderkey", "o_custkey", "o_orderstatus"]
_DAILY_SQL = f"""SELECT o_custkey AS cust_id, CAST(o_orderdate AS DATE) AS day, count(*) AS num_orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total, min(o_orderkey) AS smallest, max(o_orderkey) AS largest,
       avg(o_orderkey) AS mean_key, max(o_orderdate) AS last_updated_at, CAST(sum({hash_sql(_HASHED)}) AS BIGINT) AS checksum FROM {{t}} GROUP BY 1, 2"""


def _daily(rows: DataFrame) -> DataFrame:
    return grouped(rows, _KEYS, _AGGREGATES, _HASHED, "checksum")


@query(_DAILY_SQL.format(t="orders"))
def group_daily(spark: SparkSession, d: str) -> DataFrame:
    return _daily(table(spark, d, "orders"))


#: Groups as they were when the orders of every seventh key had not come yet, up to the cut-off.
_BEFORE = f"(SELECT * FROM orders WHERE o_orderdate < {_CUT} AND NOT (o_orderkey % 7 = 0 AND o_orderdate >= TIMESTAMP '1996-12-01'))"
_AGG_SQL = f"""WITH agg_dst AS ({_DAILY_SQL.format(t=_BEFORE)}), changed AS (SELECT * FROM orders WHERE o_orderdate >= (SELECT max(last_updated_at) FROM agg_dst)),
keys AS (SELECT DISTINCT o_custkey AS k, CAST(o_orderdate AS DATE) AS dd FROM changed), fresh AS (
  {_DAILY_SQL.format(t="(SELECT * FROM orders WHERE (o_custkey, CAST(o_orderdate AS DATE)) IN (SELECT (k, dd) FROM keys))")}
)"""


def _agg_dst(spark: SparkSession, d: str) -> DataFrame:
    cut = "o_orderdate < TIMESTAMP_NTZ'1997-01-01' AND NOT (o_orderkey % 7 = 0 AND o_orderdate >= TIMESTAMP_NTZ'1996-12-01')"
    return _daily(table(spark, d, "orders").where(cut))


def _fresh(spark: SparkSession, d: str) -> DataFrame:
    return S.aggregate_delta(table(spark, d, "orders"), _agg_dst(spark, d), "o_orderdate", "last_updated_at", _KEYS, _AGGREGATES, _HASHED, "checksum")


_AGG_COLUMNS = "cust_id, day, num_orders, total, last_updated_at, checksum"


@query(f"{_AGG_SQL} SELECT {_AGG_COLUMNS} FROM agg_dst WHERE (cust_id, day) NOT IN (SELECT (cust_id, day) FROM fresh) UNION ALL SELECT {_AGG_COLUMNS} FROM fresh")
def sync_agg_delta(spark: SparkSession, d: str) -> DataFrame:
    return upsert(_agg_dst(spark, d), saved(_fresh(spark, d)), ["cust_id", "day"]).selectExpr(*_AGG_COLUMNS.split(", "))


@query(f"{_AGG_SQL} SELECT f.cust_id, f.day, f.num_orders, f.total, f.checksum, CASE WHEN o.cust_id IS NULL THEN 'A' ELSE 'M' END AS change_type FROM fresh f LEFT JOIN agg_dst o ON f.cust_id = o.cust_id AND f.day = o.day WHERE o.cust_id IS NULL OR o.checksum <> f.checksum")
def sync_agg_delta_changed(spark: SparkSession, d: str) -> DataFrame:
    return S.aggregate_delta_changed(_fresh(spark, d), _agg_dst(spark, d), ["cust_id", "day"], "checksum").select("cust_id", "day", "num_orders", "total", "checksum", "change_type")


@query(
    f"""WITH agg_dst AS ({_DAILY_SQL.format(t=_BEFORE)}), s AS (SELECT CAST(o_custkey // 20 AS VARCHAR) AS partition_id, count(*) AS n, CAST(sum({hash_sql(_HASHED)}) AS BIGINT) AS h FROM orders GROUP BY 1),
    t AS (SELECT CAST(cust_id // 20 AS VARCHAR) AS partition_id, count(*) AS n, CAST(sum(checksum) AS BIGINT) AS h FROM agg_dst GROUP BY 1)
    SELECT coalesce(s.partition_id, t.partition_id) AS partition_id, CASE WHEN t.n IS NULL THEN 'A' WHEN s.n IS NULL THEN 'D' WHEN s.h = t.h THEN 'N' ELSE 'M' END AS status,
           greatest(coalesce(s.n, 0), coalesce(t.n, 0)) AS num_rows, coalesce(s.n, 0) - coalesce(t.n, 0) AS count_diff FROM s FULL JOIN t ON s.partition_id = t.partition_id"""
)
def sync_agg_hash(spark: SparkSession, d: str) -> DataFrame:
    return S.aggregate_hash(table(spark, d, "orders"), _agg_dst(spark, d), [Dimension("o_custkey", 20)], [Dimension("cust_id", 20)], _HASHED, "checksum")


#: Groups that sets of changes keep up to date.
_BY_CUSTOMER = increments.Groups(
    {"cust_id": "cust_id", "status": "status"},
    {"ids": increments.Measure("sum", "id"), "smallest": increments.Measure("min", "id"), "largest": increments.Measure("max", "id"), "first": increments.Measure("min", "updated_at"), "last": increments.Measure("max", "updated_at")},
    ("id", "status"),
)
_BY_CUSTOMER_SQL = f"SELECT cust_id, status, count(*) AS num_rows, CAST(sum(id) AS BIGINT) AS ids, count(id) AS ids__n, min(id) AS smallest, max(id) AS largest, min(updated_at) AS first, max(updated_at) AS last, CAST(sum({hash_sql(['id', 'status'])}) AS BIGINT) AS checksum FROM {{t}} GROUP BY 1, 2"


def _increments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Groups of the destination, and what the changes that bring it in step with the source make of them."""
    s, t = src(spark, d), dst(spark, d)
    stored = saved(_BY_CUSTOMER.of(t))
    return stored, saved(increments.merged(stored, row_diff(s, t, ["id"], HASHED, old=True), s, _BY_CUSTOMER))


@query(f"WITH {PAIR_SQL} {_BY_CUSTOMER_SQL.format(t='src')}")
def sync_agg_signed(spark: SparkSession, d: str) -> DataFrame:
    stored, changed = _increments(spark, d)
    return apply_changes(stored, changed, ["cust_id", "status"])


@query(f"""WITH {PAIR_SQL}, n AS ({_BY_CUSTOMER_SQL.format(t="src")}), o AS ({_BY_CUSTOMER_SQL.format(t="dst")})
SELECT coalesce(n.cust_id, o.cust_id) AS cust_id, coalesce(n.status, o.status) AS status, CASE WHEN o.cust_id IS NULL THEN 'A' WHEN n.cust_id IS NULL THEN 'D' ELSE 'M' END AS change_type
FROM n FULL JOIN o ON n.cust_id = o.cust_id AND n.status = o.status WHERE o.cust_id IS NULL OR n.cust_id IS NULL OR n.checksum <> o.checksum""")
def sync_agg_signed_changes(spark: SparkSession, d: str) -> DataFrame:
    return _increments(spark, d)[1].select("cust_id", "status", "change_type")


@query("SELECT o_orderkey, o_orderstatus, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS BIGINT) AS score FROM orders")
def schema_evolve_add(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return evolve(old, spark.createDataFrame([], "o_orderkey bigint, note string, score bigint").schema)


@query("SELECT o_orderkey, CAST(CAST(o_custkey AS INTEGER) AS BIGINT) AS o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def schema_evolve_widen(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("int").alias("o_custkey"), F.col("o_orderdate").alias("day"))
    return evolve(old, spark.createDataFrame([], "o_custkey bigint, day date").schema)


@query("SELECT event_id, user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The last event per user and type, from a stream of files taken one at a time."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    rows.repartitionByRange(4, "event_id").write.parquet(source := folder(spark))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    running = start_upsert(stream, target := folder(spark), folder(spark), ["user_id", "event_type"], ["ts", "event_id"])
    running.awaitTermination()
    return latest(spark, target, rows.schema)


@query("SELECT o_orderkey, CAST(o_custkey AS DECIMAL(22,3)) AS o_custkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DECIMAL(14,4)) AS price FROM orders")
def schema_evolve_lift(spark: SparkSession, d: str) -> DataFrame:
    """Types that do not hold the old values give way to the least that holds both."""
    old = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    return evolve(old, spark.createDataFrame([], "o_custkey decimal(12,3), price decimal(8,4)").schema, lift=True)


def _versions(spark: SparkSession, d: str) -> str:
    """A versioned table of the last event per user and type: even events first, then all others."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    target = folder(spark)
    for n in (0, 1):
        versioned.upsert(rows.where(F.col("event_id") % 2 == n), target, ["user_id", "event_type"], ["ts", "event_id"], buckets=16)
    return target


_LAST_EVENT = "SELECT event_id, user_id, event_type, ts FROM events {where} QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"


@query(_LAST_EVENT.format(where=""))
def versioned_upsert(spark: SparkSession, d: str) -> DataFrame:
    return versioned.read(spark, _versions(spark, d))


@query(_LAST_EVENT.format(where="WHERE event_id % 2 = 0"))
def versioned_read_before(spark: SparkSession, d: str) -> DataFrame:
    """The version before the last."""
    return versioned.read(spark, _versions(spark, d), 1)


@query(f"WITH {PAIR_SQL} SELECT * FROM src")
def versioned_changes(spark: SparkSession, d: str) -> DataFrame:
    """A table brought in step with its source by a set of changes, deletions among them."""
    s, t = src(spark, d), dst(spark, d)
    versioned.apply_changes(S.full(t), target := folder(spark), ["id"], buckets=16)
    versioned.apply_changes(saved(S.hash_changes(s, t, BY_100, ["id"], HASHED)), target, ["id"], buckets=16)
    return versioned.read(spark, target)


_LEDGER_SQL = f"""WITH {PAIR_SQL}, parts AS (SELECT CAST(id // 100 AS VARCHAR) AS partition_id, count(*) AS num_rows, CAST(sum({hash_sql(HASHED)}) AS BIGINT) AS hash FROM src GROUP BY 1),
ledger AS (SELECT CAST(id // 100 AS VARCHAR) AS partition_id, CAST(sum({hash_sql(HASHED)}) AS BIGINT) AS hash, CASE WHEN CAST(min(id // 100) AS BIGINT) % 6 = 0 THEN 'failed' ELSE 'completed' END AS status FROM dst GROUP BY 1)"""


def _ledger(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ledger = bucket_hashes(dst(spark, d), BY_100, HASHED)
    return bucket_hashes(src(spark, d), BY_100, HASHED), ledger.withColumn("status", F.expr("CASE WHEN CAST(partition_id AS BIGINT) % 6 = 0 THEN 'failed' ELSE 'completed' END"))


@query(f"{_LEDGER_SQL} SELECT p.* FROM parts p WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.partition_id = p.partition_id AND l.hash = p.hash AND l.status = 'completed')")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    return audit.pending(*_ledger(spark, d))


@query(f"{_LEDGER_SQL} SELECT p.* FROM parts p WHERE partition_id IN (SELECT partition_id FROM ledger WHERE status = 'failed')")
def retry_failed(spark: SparkSession, d: str) -> DataFrame:
    return audit.failed(*_ledger(spark, d))


@query(f"{_LEDGER_SQL} SELECT p.* FROM parts p WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.partition_id = p.partition_id AND l.hash = p.hash AND l.status = 'completed')")
def resume_after_runs(spark: SparkSession, d: str) -> DataFrame:
    """The ledger as runs have written it: all partitions failed at first, most were completed later."""
    parts, done = _ledger(spark, d)
    path = folder(spark)
    audit.record_partitions(done, path, "failed")
    audit.record_partitions(done.where("status = 'completed'"), path, "completed")
    return audit.pending(parts, audit.ledger(spark, path))


_BY_10000 = [Dimension("id", 10_000)]


def _interrupted(spark: SparkSession, d: str) -> tuple[str, str]:
    """Table and ledger of a run that is lost in its second group and started again; every third partition
    fails at its first attempt there."""
    s, target, path = src(spark, d), folder(spark), folder(spark)
    parts, write, failed, groups = bucket_hashes(s, _BY_10000, HASHED), resume.copy_partitions(s, target, _BY_10000, ["id"], HASHED), set(), []

    def lost(ids: list[str]) -> None:
        groups.append(ids)
        if len(groups) == 2:
            raise KeyboardInterrupt
        write(ids)

    def unreliable(ids: list[str]) -> None:
        if new := {i for i in ids if int(i) % 3 == 1} - failed:
            failed.update(new)
            raise OSError("not at first")
        write(ids)

    try:
        resume.run_partitions(parts, resume.Ledger(spark, path), lost, group=2)
    except KeyboardInterrupt:
        pass
    resume.run_partitions(parts, resume.Ledger(spark, path, lease=0.0), unreliable, group=4, threads=4)
    return target, path


@query(f"WITH {PAIR_SQL} SELECT * FROM src")
def resume_interrupted_run(spark: SparkSession, d: str) -> DataFrame:
    return versioned.read(spark, _interrupted(spark, d)[0])


@query(f"WITH {PAIR_SQL} SELECT DISTINCT CAST(id // 10000 AS VARCHAR) AS partition_id, 'completed' AS status FROM src")
def resume_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger afterwards: every partition is completed, once."""
    return resume.Ledger(spark, _interrupted(spark, d)[1]).states().select("partition_id", "status")


@query(f"{_ROWS_SQL} SELECT 'orders' AS job, 'hash' AS strategy, 'r1' AS run, 'completed' AS status, count(*) FILTER (change_type = 'A') AS inserted, count(*) FILTER (change_type = 'M') AS updated, count(*) FILTER (change_type = 'D') AS deleted FROM st")
def run_recorded(spark: SparkSession, d: str) -> DataFrame:
    """The history after one run."""
    changes = saved(S.hash_changes(src(spark, d), dst(spark, d), BY_100, ["id"], HASHED))
    audit.record_run(changes, path := folder(spark), "orders", "hash", "r1")
    return audit.list_runs(spark.read.parquet(path), "orders").drop("start_time")


_RUNS_SQL = "(SELECT event_type AS job, user_id AS strategy, event_id AS run, ts AS start_time, CASE WHEN event_id % 10 = 0 THEN 'failed' ELSE 'completed' END AS status FROM events)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    status = "CASE WHEN event_id % 10 = 0 THEN 'failed' ELSE 'completed' END AS status"
    return table(spark, d, "events").selectExpr("event_type AS job", "user_id AS strategy", "event_id AS run", "ts AS start_time", status)


@query(f"SELECT * FROM {_RUNS_SQL} WHERE status = 'failed' ORDER BY start_time DESC, run DESC LIMIT 40 OFFSET 10")
def runs_list(spark: SparkSession, d: str) -> DataFrame:
    return audit.list_runs(_runs(spark, d), status="failed", limit=40, offset=10)


@query(f"SELECT job, count(*) AS total_runs, max(start_time) AS last_run, arg_max(status, (start_time, run)) AS last_status FROM {_RUNS_SQL} GROUP BY 1")
def jobs_summary(spark: SparkSession, d: str) -> DataFrame:
    return audit.jobs_summary(_runs(spark, d))

