"""Strategies: which rows a run writes. Each gives a frame of changes with change_type, which
``tidemark.sources.writers.apply_changes`` applies. Watermarks and changed buckets are found first, as
literals that reach the scans; rows are read when the changes are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregate import grouped
from tidemark.operators.diff import bucket_diff, bucket_hashes, hash_changes, row_diff
from tidemark.operators.increments import rows_of_groups
from tidemark.plans.bounds import greatest
from tidemark.sources.readers import has_data
from tidemark.spec import Dimension
from tidemark.work import saved


def full(src: DataFrame) -> DataFrame:
    """Every row of the source, tagged A."""
    return src.withColumn("change_type", F.lit("A"))


def _since(src: DataFrame, watermark: str, dst: DataFrame, dst_watermark: str) -> DataFrame:
    """Source rows from the destination's high watermark on, all that have one if the destination is empty.
    The boundary is inside: its rows are read again, and upserts make that harmless."""
    start = greatest(dst, dst_watermark)
    return src.where(F.col(watermark).isNotNull() if start is None else F.col(watermark) >= start)


def delta(src: DataFrame, dst: DataFrame, watermark: str) -> DataFrame:
    """Rows that are new by the watermark column, tagged M."""
    return _since(src, watermark, dst, watermark).withColumn("change_type", F.lit("M"))


def delta_changed(src: DataFrame, dst: DataFrame, watermark: str, keys: list[str], hashed: list[str]) -> DataFrame:
    """As ``delta``, without rows that the destination has already. The destination is restricted to the
    keys that changed, so that no row comes out as deleted."""
    new = _since(src, watermark, dst, watermark)
    return row_diff(new, dst.join(new.select(*keys), keys, "left_semi"), keys, hashed)


def auto(src: DataFrame, dst: DataFrame, dims: list[Dimension], keys: list[str], hashed: list[str], watermark: str, wish: str | None = None, bounded: bool = False) -> DataFrame:
    """An empty destination takes all; with bounds, or where full is asked for on a destination that has
    rows, checksums decide; else the watermark does."""
    if not has_data(dst):
        return full(src)
    if bounded or wish in ("full", "hash"):
        return hash_changes(src, dst, dims, keys, hashed)
    return delta(src, dst, watermark)


def aggregate_delta(src: DataFrame, dst: DataFrame, watermark: str, dst_watermark: str, keys: dict[str, str], aggregates: dict[str, str], hashed: list[str] | None = None, hash_name: str = "group_hash") -> DataFrame:
    """Groups that changed rows affect, aggregated again over all their rows, tagged M. Their keys are
    written once, and bound what is read of the source again (``rows_of_groups``). Where the rows that changes
    replace are known, ``tidemark.operators.increments`` needs no rows of groups at all."""
    new = _since(src, watermark, dst, dst_watermark)
    affected = saved(new.select(*[F.expr(e).alias(n) for n, e in keys.items()]).distinct())
    return grouped(rows_of_groups(src, affected, keys), keys, aggregates, hashed, hash_name).withColumn("change_type", F.lit("M"))


def aggregate_delta_changed(fresh: DataFrame, dst: DataFrame, keys: list[str], hash_name: str, affected: DataFrame | None = None) -> DataFrame:
    """Of re-aggregated groups, those whose hash differs (M) or that are new (A); groups of ``affected``
    keys that have no rows any more come out as D."""
    d = dst.select(*keys, F.col(hash_name).alias("_old"))
    changed = fresh.drop("change_type").join(d, keys, "left").where(~F.col("_old").eqNullSafe(F.col(hash_name)))
    out = changed.withColumn("change_type", F.when(F.col("_old").isNull(), "A").otherwise("M")).drop("_old")
    if affected is None:
        return out
    gone = dst.join(affected.select(*keys), keys, "left_semi").join(fresh.select(*keys), keys, "left_anti")
    return out.unionByName(gone.withColumn("change_type", F.lit("D")), allowMissingColumns=True)


def aggregate_hash(src: DataFrame, dst: DataFrame, src_dims: list[Dimension], dst_dims: list[Dimension], hashed: list[str], stored: str) -> DataFrame:
    """Buckets in which raw rows and stored group hashes differ; counts are not compared, as a bucket has
    fewer groups than rows."""
    return bucket_diff(bucket_hashes(src, src_dims, hashed), bucket_hashes(dst, dst_dims, stored=stored), skip_row_count=True)


__all__ = ["full", "delta", "delta_changed", "auto", "aggregate_delta", "aggregate_delta_changed", "aggregate_hash", "hash_changes"]
