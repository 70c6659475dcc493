"""Sinks as relations (the destination after the write), file writers, and rejected rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.casting import cast_to_schema
from tidemark.spec import ColumnSpec
from tidemark.work import folder, saved


def _without(dst: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys ``gone`` does not have; null is a key like any other, as it is in ``keep_last``."""
    names = {k: f"_gone_{k}" for k in keys}
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return dst.join(gone.select(*[F.col(k).alias(n) for k, n in names.items()]), same, "left_anti")


def upsert(dst: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The destination with changed rows put in place of those of their keys (null is a key), under the destination's
    columns. The changes are read twice, for their keys and for their rows: costly ones are better saved
    first (``tidemark.work.saved``). Rows that stay are moved only if the keys are too many to broadcast."""
    changes = changes.select(*dst.columns)
    return _without(dst, changes, keys).unionByName(changes)


def delete_insert(dst: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """As ``upsert``, in two steps, for sinks that cannot replace rows."""
    return append(delete_by_keys(dst, changes, keys), changes)


def append(dst: DataFrame, rows: DataFrame) -> DataFrame:
    return dst.unionByName(rows.select(*dst.columns))


def delete_where(dst: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true (null keeps a row, as in SQL)."""
    return dst.where(~F.coalesce(condition, F.lit(False)))


def delete_by_keys(dst: DataFrame, keys_frame: DataFrame, keys: list[str]) -> DataFrame:
    return _without(dst, keys_frame, keys)


def apply_changes(dst: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The destination after a set of changes with change_type: D rows go, A and M rows replace. The changes
    are computed once and saved, at once."""
    changes = saved(changes)
    kept = delete_by_keys(dst, changes, keys)
    return kept.unionByName(changes.where("change_type IN ('A', 'M')").select(*dst.columns))


def change_counters(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_type").agg(F.count("*").alias("num_rows"))


def quarantine(df: DataFrame, columns: tuple[ColumnSpec, ...], tag: str = "failed__") -> tuple[DataFrame, DataFrame]:
    """(good rows under the declared types, rejected rows with the reasons in ``tag``), in one pass
    over the input each. A row is rejected if a value cannot be cast or a value that must be there
    is null."""
    checked = cast_to_schema(df, {c.name: c.data_type for c in columns if c.data_type})
    missing = F.array_compact(F.array(*[F.when(F.col(c.name).isNull(), F.lit(f"{c.name} is null")) for c in columns if not c.nullable] or [F.lit(None).cast("string")]))
    reasons = F.concat(F.transform("_cast_errors", lambda c: F.concat(c, F.lit(" cannot be cast"))), missing)
    flagged = checked.withColumn(tag, reasons).drop("_cast_errors")
    return flagged.where(F.size(tag) == 0).drop(tag), flagged.where(F.size(tag) > 0)


def failed_partitions(rejected: DataFrame, column: str = "partition_id") -> DataFrame:
    return rejected.select(column).distinct()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(nullValue="", emptyValue='""', timestampNTZFormat="yyyy-MM-dd HH:mm:ss").csv(path, header=True)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").json(path)


def rows_per_file(df: DataFrame, target_bytes: int, sample: int = 100_000) -> int:
    """How many rows of ``df`` make a Parquet file of about ``target_bytes``, from what about ``sample`` rows of it take."""
    n = df.count()
    path = folder(df.sparkSession)
    df.sample(min(1.0, sample / max(1, n)), 1).coalesce(1).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).count()
    taken = df.sparkSession.read.format("binaryFile").load(f"{path}/*.parquet").agg(F.sum("length")).first()[0]
    return max(1, target_bytes * max(1, rows) // max(1, taken or 1))


def planned(df: DataFrame, rows: int, by: str = "change_type") -> tuple[DataFrame, int]:
    """``df`` with the number of the file that each row goes to, in file__, and the number of files. A type of n rows
    has ceil(n / rows) files, whose sizes differ by one row at most: small batches of rows are joined, large
    ones are cut, wherever they come from. Rows are numbered within their task, and tasks by sums of counts; only
    counts per type reach the driver."""
    there = saved(df.withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = there.groupBy(by, "_task").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(by, "_task", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    totals = sorted(((r[0], r[1]) for r in counts.groupBy(by).agg(F.sum("_n")).collect()), key=repr)
    first, number, plan = 0, F.lit(0).cast("long"), []
    for kind, n in totals:
        plan.append((kind, n, files := -(-n // rows), first))
        first += files
    place = F.col("_before") + F.row_number().over(Window.partitionBy(by, "_task").orderBy("_at")) - 1
    for kind, n, files, start in plan:
        number = F.when(F.col(by).eqNullSafe(F.lit(kind)), F.call_function("div", F.col("_place") * files, F.lit(n).cast("long")) + start).otherwise(number)
    placed = there.join(before.withColumnsRenamed({by: "_by", "_task": "_of"}), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_task") == F.col("_of"))).withColumn("_place", place)
    return placed.withColumn("file__", number.cast("int")).drop("_by", "_of", "_task", "_at", "_before", "_place"), first


def write_sized(df: DataFrame, path: str, rows: int | None = None, target_bytes: int | None = None) -> None:
    """Parquet by change type, in files of ``rows`` rows at most and half as many at least, where a type has so many;
    or of about ``target_bytes``. Every file is one task's."""
    if (rows is None) == (target_bytes is None):
        raise ValueError("either rows or target_bytes")
    df = saved(df)
    numbered, files = planned(df, rows or rows_per_file(df, target_bytes))
    numbered.repartitionById(max(1, files), "file__").drop("file__").write.partitionBy("change_type").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions that ``df`` has rows of, and no others. ``df`` may read ``path``: new files
    take the place of old ones when all are written."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def merge_into(dst_table: str, changes: DataFrame, keys: list[str]) -> None:
    """Upsert and delete in place, for tables whose format supports MERGE."""
    on = reduce(lambda a, b: a & b, [F.col(f"{dst_table}.{k}") == F.col(f"changes.{k}") for k in keys])
    gone = F.col("changes.change_type") == "D"
    changes.alias("changes").mergeInto(dst_table, on).whenMatched(gone).delete().whenMatched(~gone).updateAll().whenNotMatched(~gone).insertAll().merge()


def write_jdbc(df: DataFrame, options: dict[str, str], mode: str = "append") -> None:
    """Inserts into a table of a database, batch by batch, every partition over its own connection."""
    df.write.format("jdbc").options(**options).mode(mode).save()


def apply_jdbc(changes: DataFrame, options: dict[str, str], keys: list[str], types: str = "", quote: str = '"') -> None:
    """Brings changes with change_type into a table of a database. They are staged beside it in parallel,
    and taken over in one transaction in the database: rows of their keys go, A and M rows come. A run
    that is repeated gives the same table. types: the database's types of key columns that are texts, as
    "name VARCHAR(100), ...", where its type for texts cannot be compared."""
    table, stage = options["dbtable"], f"{options['dbtable']}_changes"
    write_jdbc(changes, options | {"dbtable": stage, "createTableColumnTypes": ", ".join(filter(None, ["change_type VARCHAR(1)", types]))}, "overwrite")
    q = lambda c: f"{quote}{c}{quote}"
    columns = ", ".join(q(c) for c in changes.columns if c != "change_type")
    same = " AND ".join(f"{table}.{q(k)} = {stage}.{q(k)}" for k in keys)
    _in_transaction(changes.sparkSession, options, [
        f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {stage} WHERE {same})",
        f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {stage} WHERE {q('change_type')} <> 'D'",
        f"DROP TABLE {stage}",
    ])


def _in_transaction(spark: SparkSession, options: dict[str, str], statements: list[str]) -> None:
    """Runs statements over the connection that Spark's own JDBC source is given."""
    jvm = spark.sparkContext._jvm
    properties = jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, v)
    if "driver" in options:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(options["url"], properties)
    try:
        connection.setAutoCommit(False)
        for sql in statements:
            connection.createStatement().execute(sql)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()
