"""What the operators of this subpackage share: inputs, durable intermediates, runs of sorted rows."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.work import shared_folder

#: The white space of the dedup contracts: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _let_workers_import(spark: SparkSession) -> None:
    """Puts this package's folder on the workers' path, for runs from a checkout; a cluster gets
    the package by --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, path]))


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that operators need, under fixed names: others are pruned from the
    scan and cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def durable(df: DataFrame) -> DataFrame:
    """Rows written once to the folder named in spark.checkpoint.dir, which every executor reads;
    lost executors cost no recomputation and the plan above starts anew. Where the setting is
    missing (tests), a folder of our own is used. Spark deletes the files when the result is
    no longer referenced, if spark.cleaner.referenceTracking.cleanCheckpoints is on."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """``names``, with underscores put before those that ``columns`` has (in either case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys, from batches sorted by those keys.

    A run that crosses batches is held until it ends, so memory is one batch and one run.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k) for k in keys]

        def at(i: int, cols: list[pa.Array] = cols) -> tuple:
            return tuple(c[i].as_py() for c in cols)

        if held and at(0) != last:
            yield pa.Table.from_batches(held)
            held = []
        end = at(n - 1)
        if at(0) == end:
            held.append(batch)
        else:
            low, high = 0, n - 1  # the first row of the last run: rows are sorted
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (low, mid) if at(mid) == end else (mid, high)
            yield pa.Table.from_batches([*held, batch.slice(0, high)])
            held = [batch.slice(high)]
        last = end
    if held:
        yield pa.Table.from_batches(held)


def spread_join(rows: DataFrame, few: DataFrame, key: str | list[str], by: str, salts: int = 64) -> DataFrame:
    """``rows`` left-joined with ``few`` (one row per key), where very many rows may share a key.

    Rows are dealt by (key, salt of ``by``): ``few`` first goes to the at most ``salts`` pairs that
    a key occurs in, so a hot key's rows spread over that many tasks and nothing is broadcast.
    """
    key = [key] if isinstance(key, str) else key
    (salt,) = unused([*rows.columns, *few.columns], "_salt")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(salts)))
    pairs = salted.select(*key, salt).distinct().join(few, key)
    return salted.join(pairs, [*key, salt], "left").drop(salt)
