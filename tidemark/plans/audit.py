"""Run history and the ledger of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.dedup import keep_last


def list_runs(runs: DataFrame, job: str | None = None, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Runs, newest first (ties by run)."""
    for column, value in (("job", job), ("status", status)):
        runs = runs.where(F.col(column) == value) if value is not None else runs
    return runs.orderBy(F.desc("start_time"), F.desc("run")).offset(offset).limit(limit)


def jobs_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("job").agg(
        F.count("*").alias("total_runs"),
        F.max("start_time").alias("last_run"),
        F.max_by("status", F.struct("start_time", "run")).alias("last_status"),
    )


def run_record(changes: DataFrame, job: str, strategy: str, run: str, status: str = "completed") -> DataFrame:
    """One row for the run history: rows per change type, and the time."""
    counts = [F.count_if(F.col("change_type") == t).alias(n) for t, n in (("A", "inserted"), ("M", "updated"), ("D", "deleted"))]
    named = {"job": job, "strategy": strategy, "run": run, "status": status}
    return changes.agg(*counts).select(*[F.lit(v).alias(c) for c, v in named.items()], F.localtimestamp().alias("start_time"), "*")


def record_run(changes: DataFrame, path: str, job: str, strategy: str, run: str, status: str = "completed") -> None:
    """Adds a run to the history at ``path``."""
    run_record(changes, job, strategy, run, status).write.mode("append").parquet(path)


def record_partitions(partitions: DataFrame, path: str, status: str) -> None:
    """Adds the state of partitions (partition_id, hash) to the ledger at ``path``."""
    state = partitions.select("partition_id", "hash", F.lit(status).alias("status"), F.localtimestamp().alias("at"))
    state.write.mode("append").parquet(path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each partition in the ledger at ``path``."""
    return keep_last(spark.read.parquet(path), ["partition_id"], ["at", "hash"])


def pending(partitions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Partitions that the ledger does not have as completed with the same hash."""
    done = ledger.where("status = 'completed'").select("partition_id", "hash")
    return partitions.join(done, ["partition_id", "hash"], "left_anti")


def failed(partitions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Partitions whose last state in the ledger is failed."""
    return partitions.join(ledger.where("status = 'failed'").select("partition_id"), "partition_id", "left_semi")
