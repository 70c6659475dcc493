"""Labelled rows to learn from, and what learned scorers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_and_text


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)), F.lit(0))


def sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, most: int) -> DataFrame:
    """(text, y) of about ``most`` labelled rows at most, of those where ``learnable`` holds.

    The ids are chosen by hash before any text is read. There are ``most`` in expectation, so that
    their side may be broadcast at any input size; labels that are null or not 0 or 1 are left out.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & learnable)
        .dropDuplicates(["doc_id"])
    )
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return id_and_text(docs).join(F.broadcast(known), "doc_id").select("text", "y")
