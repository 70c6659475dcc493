"""Dedup by keys and retention of the newest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import first_per_key


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in an order that breaks all ties; null is a key like any other. Rows are
    combined before the shuffle, so that a key of very many rows is one row per task."""
    rank = F.struct(*[F.col(c) for c in order])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns if c not in keys]), rank).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return first_per_key(df, keys, order).select(*df.columns)


def newest(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits groups before the shuffle."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")
