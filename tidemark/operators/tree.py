"""A tree of bucket hashes that is kept between runs.

Only the finest buckets, the leaves, are hashed from rows, once; since hashes add up, a coarser bucket's hash is a
sum over its leaves. A table of leaves is small against its rows: all levels of a comparison come from the
two tables of leaves. A stored table is renewed by a watermark: leaves with newer rows are hashed again,
from rows that are read by pushed ranges of their buckets, and all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.buckets import partition_id
from tidemark.functions.hashing import block_hash, row_hash_int
from tidemark.operators.diff import within_buckets
from tidemark.plans.bounds import greatest
from tidemark.sources import versioned
from tidemark.spec import Dimension
from tidemark.work import saved

Levels = list[list[Dimension]]
#: The greatest watermark of a leaf.
MARK = "mark"


def _ids(levels: Levels) -> list[Column]:
    """The bucket ids of a row at all levels; they follow the parent's."""
    return [partition_id(dims, [d for ds in levels[:k] for d in ds]).alias(f"level{k}") for k, dims in enumerate(levels)]


def leaves(df: DataFrame, levels: Levels, hashed: list[str], watermark: str | None = None, digits: int = 8) -> DataFrame:
    """level0, level1, ..., num_rows, hash and mark (null without a watermark) of the finest buckets, in one pass."""
    mark = F.col(watermark) if watermark else F.lit(None).cast("timestamp_ntz")
    rows = df.select(*_ids(levels), row_hash_int(hashed, digits).alias("_h"), mark.alias(MARK))
    return rows.groupBy(*[f"level{k}" for k in range(len(levels))]).agg(F.count("*").alias("num_rows"), block_hash("_h").alias("hash"), F.max(MARK).alias(MARK))


def level(tree: DataFrame, k: int) -> DataFrame:
    """partition_id, num_rows, hash of the buckets of a level, as hashing their rows gives them."""
    return tree.groupBy(F.col(f"level{k}").alias("partition_id")).agg(F.sum("num_rows").alias("num_rows"), block_hash("hash").alias("hash"))


def drill_tree(src: DataFrame, dst: DataFrame, levels: int, page_size: int) -> DataFrame:
    """What ``tidemark.operators.diff.drill`` gives, from two tables of leaves, which are read once: buckets that
    are A or M and hold more than ``page_size`` rows give way to their buckets at the next level."""
    last, ids = f"level{levels - 1}", [f"level{k}" for k in range(levels)]
    sides = [t.select(*[F.col(c).alias(f"{s}_{c}") for c in [*ids, "num_rows", "hash"]]) for s, t in (("s", src), ("d", dst))]
    both = sides[0].join(sides[1], F.col(f"s_{last}") == F.col(f"d_{last}"), "full_outer")
    pairs = saved(both.select(*[F.coalesce(f"s_{c}", f"d_{c}").alias(c) for c in ids], *[f"{s}_{c}" for s in "sd" for c in ("num_rows", "hash")]))
    out, parents = None, None
    for k in range(levels):
        scoped = pairs if parents is None else pairs.join(parents, f"level{k - 1}", "left_semi")
        sums = [f for s in "sd" for f in (F.coalesce(F.sum(f"{s}_num_rows"), F.lit(0)).alias(f"{s}n"), block_hash(f"{s}_hash").alias(f"{s}h"))]
        found = scoped.groupBy(F.col(f"level{k}").alias("partition_id")).agg(*sums)
        status = F.when(F.col("dn") == 0, "A").when(F.col("sn") == 0, "D").when((F.col("sh") == F.col("dh")) & (F.col("sn") == F.col("dn")), "N").otherwise("M")
        found = found.select("partition_id", status.alias("status"), F.greatest("sn", "dn").alias("num_rows"), (F.col("sn") - F.col("dn")).alias("count_diff"), F.lit(k).alias("level"))
        large = (F.col("num_rows") > page_size) & F.col("status").isin("A", "M") if k < levels - 1 else F.lit(False)
        done = found.where(~large)
        out = done if out is None else out.unionByName(done)
        parents = found.where(large).select(F.col("partition_id").alias(f"level{k}"))
    return out


def rows_of_leaves(df: DataFrame, levels: Levels, touched: DataFrame) -> DataFrame:
    """The rows of some leaves (their ids at the last level as _leaf, and alone, without their parents', as
    _bucket). Ranges of the last level's buckets reach the scan."""
    rows = within_buckets(df, levels[-1], touched.select("_bucket").distinct())
    return rows.withColumn("_leaf", _ids(levels)[-1]).join(touched.select("_leaf"), "_leaf", "left_semi").drop("_leaf")


def touched_leaves(df: DataFrame, levels: Levels, watermark: str, since: Column) -> DataFrame:
    """The leaves that have rows from a watermark on, written down."""
    new = df.where(F.col(watermark) >= since)
    return saved(new.select(_ids(levels)[-1].alias("_leaf"), partition_id(levels[-1]).alias("_bucket")).distinct())


def renew(df: DataFrame, path: str, levels: Levels, hashed: list[str], watermark: str, digits: int = 15, rebuild: bool = False) -> DataFrame:
    """The table of leaves of ``df`` that is kept at ``path`` (a versioned table), brought up to date: built if
    it is not there, or if ``rebuild`` asks for it, else renewed where rows are as new as the last watermark
    or newer. Rows that were deleted, or that moved to another bucket, leave no watermark behind; where
    these happen, the old bucket keeps its hash until it has a newer row, or the tree is rebuilt."""
    spark, keys = df.sparkSession, [f"level{len(levels) - 1}"]
    stored = None if versioned.manifest(spark, path) is None else versioned.read(spark, path)
    if stored is None or rebuild:
        fresh = leaves(df, levels, hashed, watermark, digits).withColumn("change_type", F.lit("A"))
        if stored is not None:
            gone = stored.join(fresh.select(*keys), keys, "left_anti").withColumn("change_type", F.lit("D"))
            fresh = saved(fresh.unionByName(gone))
        versioned.apply_changes(fresh, path, keys, buckets=16)
    elif (since := greatest(stored, MARK)) is not None:
        rows = rows_of_leaves(df, levels, touched_leaves(df, levels, watermark, since))
        versioned.apply_changes(saved(leaves(rows, levels, hashed, watermark, digits).withColumn("change_type", F.lit("M"))), path, keys, buckets=16)
    return versioned.read(spark, path)
