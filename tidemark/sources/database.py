"""Databases by their Python drivers (DB-API 2.0), where a row that the target refuses must not fail the rest.

``connect`` is a function without arguments that gives a connection in transactions; tasks call it, so
what it needs must be there on every executor. Spark's own JDBC source and sink (``tidemark.sources.readers``,
``tidemark.sources.writers``) are faster where no row is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructType

from tidemark.work import saved

Connect = Callable[[], Any]
#: Exceptions, by name, that one row's values cause. Others, those of connections, locks and statements
#: among them, fail the task, which Spark repeats.
DATA_ERRORS = ("DataError", "IntegrityError", "OverflowError")
#: The column of the database's message.
ERROR = "error__"
BATCH = 1000


def _is_data_error(e: BaseException) -> bool:
    return any(c.__name__ in DATA_ERRORS for c in type(e).__mro__)


def _insert(cursor: Any, sql: str, rows: list[tuple], first: int, refused: list[tuple[int, str]]) -> None:
    """Inserts rows under a savepoint; if the database refuses them, halves of them, down to single rows."""
    if not rows:
        return
    cursor.execute("SAVEPOINT rows_of_a_batch")
    try:
        cursor.executemany(sql, rows)
    except Exception as e:
        if not _is_data_error(e):
            raise
        cursor.execute("ROLLBACK TO SAVEPOINT rows_of_a_batch")
        # a rollback keeps its savepoint, and every savepoint that is open slows down all later statements
        cursor.execute("RELEASE SAVEPOINT rows_of_a_batch")
        if len(rows) == 1:
            refused.append((first, str(e).strip()))
        else:
            half = len(rows) // 2
            _insert(cursor, sql, rows[:half], first, refused)
            _insert(cursor, sql, rows[half:], first + half, refused)
        return
    cursor.execute("RELEASE SAVEPOINT rows_of_a_batch")


def insert_rows(df: DataFrame, connect: Connect, table: str, batch: int = BATCH, mark: str = "?", quote: str = '"', ledger: str | None = None, run: str | None = None) -> DataFrame:
    """Inserts ``df`` into a table and returns the rows that the database refused, with its message in
    ``error__``. Runs at once; every partition is one transaction over a connection of its own. A batch that
    is refused is halved until the rows at fault are alone: about log2(batch) statements for each of them. The next
    batch goes in runs as long as one refused row had good ones about it: where most rows are refused, one by one.

    mark: how the driver marks a parameter (? or %s). quote: the quotes of names. ledger: a table that is made if it is not there, ``<table>_writes`` by
    default. In it each transaction notes that its partition is done and what was refused, so a task that is
    repeated after its commit, or a whole call that is repeated with the same ``run`` and the same rows, inserts nothing twice
    and returns the same rows. Rows are saved first: a repeated task has the same rows in the same order.

    Of rows of one call that exclude each other it is undefined which one stays, unless they are in one
    partition, where the first one does. Constraints that a database only checks at commit fail the task.
    """
    run, ledger = run or uuid.uuid4().hex, ledger or f"{table}_writes"
    rows = saved(df)
    opened = connect()
    try:
        opened.cursor().execute(f"CREATE TABLE IF NOT EXISTS {ledger} (run VARCHAR(64) NOT NULL, part INTEGER NOT NULL, refused TEXT, PRIMARY KEY (run, part))")
        opened.commit()
    finally:
        opened.close()
    sql = f"INSERT INTO {table} ({', '.join(f'{quote}{c}{quote}' for c in df.columns)}) VALUES ({', '.join([mark] * len(df.columns))})"
    marks = f"run = {mark} AND part = {mark}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (run, TaskContext.get().partitionId())
        connection = connect()
        try:
            cursor = connection.cursor()
            try:  # a write comes first: the transaction holds its lock from the start
                cursor.execute(f"INSERT INTO {ledger} (run, part) VALUES ({mark}, {mark})", key)
            except Exception as e:
                if not _is_data_error(e):
                    raise
                connection.rollback()
                cursor.execute(f"SELECT refused FROM {ledger} WHERE {marks}", key)
                refused = json.loads(cursor.fetchone()[0])
                kept, at = [], 0
                for b in batches:
                    kept.append((at, b))
                    at += b.num_rows
            else:
                refused, kept, at, size = [], [], 0, batch
                for b in batches:
                    values, before = list(zip(*[c.to_pylist() for c in b.columns], strict=True)), len(refused)
                    for start in range(0, len(values), batch):
                        some, were = values[start : start + batch], len(refused)
                        for i in range(0, len(some), size):
                            _insert(cursor, sql, some[i : i + size], at + start + i, refused)
                        size = max(1, len(some) // (len(refused) - were + 1))
                    if len(refused) > before:
                        kept.append((at, b))
                    at += b.num_rows
                cursor.execute(f"UPDATE {ledger} SET refused = {mark} WHERE {marks}", (json.dumps(refused), *key))
                connection.commit()
        finally:
            connection.close()
        for start, b in kept:
            own = [(i - start, why) for i, why in refused if start <= i < start + b.num_rows]
            if own:
                some = b.take(pa.array([i for i, _ in own]))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([why for _, why in own])], names=[*b.schema.names, ERROR])

    return saved(rows.mapInArrow(write, StructType([*rows.schema]).add(ERROR, StringType())))


def read_rows(spark: SparkSession, connect: Connect, statements: list[str], schema: str, fetch: int = 10_000) -> DataFrame:
    """The rows of some SELECT statements, one task each, such as one for each cell of a grid. Columns go by
    place. Rows stream through: ``fetch`` at a time are held."""
    empty = spark.createDataFrame([], schema)
    names, kinds = empty.columns, empty.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        for batch in batches:
            for (statement,) in zip(batch.column(0).to_pylist(), strict=True):
                connection = connect()
                try:
                    cursor = connection.cursor()
                    cursor.execute(statement)
                    while rows := cursor.fetchmany(fetch):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], names=names)
                finally:
                    connection.close()

    asked = spark.createDataFrame([(i, s) for i, s in enumerate(statements)], "i int, statement string")
    return asked.repartitionByRange(max(1, len(statements)), "i").select("statement").mapInArrow(run, kinds)
