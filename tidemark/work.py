"""Folders for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share. Where the setting is missing,
    a local folder serves a single process (tests); on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(base)
    return context.getCheckpointDir().rstrip("/")


_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Folders made within it are removed at its end, for services that run many syncs: results that are still to be
    computed from them must have been written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for base in _SCOPES.pop():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder, which is removed when the application ends, or its scope."""
    base = f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    if _SCOPES:
        _SCOPES[-1].append(base)
    return f"{base}/rows"


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder: what reads the result twice reads files,
    whose size Spark knows, and lost executors cost no recomputation."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listed(spark: SparkSession, texts: list[str], column: str) -> DataFrame:
    """A few texts as a frame that is part of the plan: no task is started to read it."""
    return spark.createDataFrame(pa.table({column: pa.array(texts, pa.string())}))
