"""Micro-batch upserts of a stream of changed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.sources import versioned


def start_upsert(stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = 64, grace: float = versioned.GRACE) -> StreamingQuery:
    """Upserts every micro-batch into a versioned table (``tidemark.sources.versioned``) that is divided into
    buckets by key. A batch reads and rewrites only the buckets that its rows are in, so its cost is that of the
    rows it meets. Per key the last row in ``order`` stays, whichever batch it came in, so late rows do not
    replace newer ones. A batch is a version, or nothing: one that failed at any point and is repeated gives what
    it would have given, and one that had been published is not written again. Another number of buckets
    than the table was made with is refused. Reads what is there and stops."""

    def write(batch: DataFrame, n: int) -> None:
        versioned.upsert(batch, target, keys, order, buckets, source=checkpoint, batch=n, grace=grace)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The target's rows; none if no batch had any."""
    return spark.createDataFrame([], schema) if versioned.manifest(spark, target) is None else versioned.read(spark, target)
