"""Change detection between a source and a destination: by buckets, by rows, and by both.

Statuses are A (only in the source), M (differs), D (only in the destination) and N (no change).
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.buckets import bounds, partition_id
from tidemark.functions.hashing import block_hash, row_hash_int
from tidemark.operators.aggregate import column_limits
from tidemark.spec import Dimension
from tidemark.work import saved

__all__ = ["bucket_hashes", "bucket_diff", "row_diff", "row_status", "hash_changes", "drill_changes", "orphans", "drill", "summary", "column_limits"]


def bucket_hashes(df: DataFrame, dims: list[Dimension], hashed: list[str] | None = None, stored: str | None = None, outer: list[Dimension] = (), digits: int = 8) -> DataFrame:
    """partition_id, num_rows, hash per bucket, in one aggregation that is combined before its
    shuffle. ``stored``: a column that holds the row hash already; ``digits``: hex digits of a row's hash."""
    h = F.col(stored) if stored else row_hash_int(hashed, digits)
    rows = df.select(partition_id(dims, outer).alias("partition_id"), h.alias("_h"))
    return rows.groupBy("partition_id").agg(F.count("*").alias("num_rows"), block_hash("_h").alias("hash"))


def _status(src_there: Column, dst_there: Column, same: Column) -> Column:
    return F.when(~dst_there, "A").when(~src_there, "D").when(same, "N").otherwise("M")


def bucket_diff(src: DataFrame, dst: DataFrame, skip_row_count: bool = False) -> DataFrame:
    """partition_id, status, num_rows (of the larger side) and count_diff (source less destination) of
    two results of ``bucket_hashes``."""
    s, d = src.alias("s"), dst.alias("d")
    both = s.join(d, F.col("s.partition_id") == F.col("d.partition_id"), "full_outer")
    same = F.col("s.hash").eqNullSafe(F.col("d.hash"))
    if not skip_row_count:
        same &= F.col("s.num_rows") == F.col("d.num_rows")
    n_s, n_d = F.coalesce("s.num_rows", F.lit(0)), F.coalesce("d.num_rows", F.lit(0))
    return both.select(
        F.coalesce("s.partition_id", "d.partition_id").alias("partition_id"),
        _status(F.col("s.partition_id").isNotNull(), F.col("d.partition_id").isNotNull(), same).alias("status"),
        F.greatest(n_s, n_d).alias("num_rows"),
        (n_s - n_d).alias("count_diff"),
    )


def require_unique(df: DataFrame, keys: list[str]) -> None:
    """Raises ValueError if a key occurs twice; one row reaches the driver."""
    if not df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"{keys} are not unique")


def row_status(src: DataFrame, dst: DataFrame, keys: list[str], hashed: list[str], old: bool = False, check: bool = False) -> DataFrame:
    """Every key with its status and the source's columns (the destination's for D); ``old`` adds the
    destination's row as struct old__. Rows are the same if all ``hashed`` columns are, null being equal to
    null: both rows are there, so they are compared themselves. ``check`` makes sure that keys are unique
    on both sides."""
    if check:
        require_unique(src, keys)
        require_unique(dst, keys)
    columns = src.columns
    s = src.withColumn("_there", F.lit(True)).alias("s")
    d = dst.select(*columns).withColumn("_there", F.lit(True)).alias("d")
    both = s.join(d, reduce(and_, [F.col(f"s.{k}") == F.col(f"d.{k}") for k in keys]), "full_outer")
    there, before = F.col("s._there").isNotNull(), F.col("d._there").isNotNull()
    out = [F.when(there, F.col(f"s.{c}")).otherwise(F.col(f"d.{c}")).alias(c) for c in columns]
    same = reduce(and_, [F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}")) for c in hashed], F.lit(True))
    extra = [F.when(before, F.struct(*[F.col(f"d.{c}").alias(c) for c in columns])).alias("old__")] if old else []
    return both.select(*out, _status(there, before, same).alias("change_type"), *extra)


def row_diff(src: DataFrame, dst: DataFrame, keys: list[str], hashed: list[str], old: bool = False, check: bool = False) -> DataFrame:
    """``row_status`` without unchanged rows."""
    return row_status(src, dst, keys, hashed, old, check).where("change_type <> 'N'")


#: Changed buckets that are looked at one by one for what can be read of a table, and boxes of them that are
#: pushed to its scan; beyond either, the least and greatest bucket in each dimension bound the scan. Values of
#: a dimension of values that are listed.
LISTED, RANGES, VALUES = 10_000, 100, 1000
#: Hex digits of the row hashes that buckets are compared by.
DIGITS = 15

Box = tuple[tuple[int, int], ...]  # first and last bucket in each dimension


def boxes(cells: list[tuple[int, ...]]) -> list[Box]:
    """Boxes that hold the given cells and no others: neighbours are joined in the last dimension, then in the
    one before it where the rest is equal, and so on."""
    found: set[Box] = {tuple((i, i) for i in cell) for cell in cells}
    for d in reversed(range(len(cells[0]) if cells else 0)):
        rows: dict[tuple, list[tuple[int, int]]] = {}
        for box in found:
            rows.setdefault((*box[:d], *box[d + 1 :]), []).append(box[d])
        found = set()
        for rest, spans in rows.items():
            first, last = None, None
            for lo, hi in [*sorted(spans), (None, None)]:
                if first is not None and lo is not None and lo <= last + 1:
                    last = max(last, hi)
                    continue
                if first is not None:
                    found.add((*rest[:d], (first, last), *rest[d:]))
                first, last = lo, hi
    return sorted(found)


def _boxes_of(changed: DataFrame, dims: list[Dimension]) -> tuple[list[Box], bool] | None:
    """(boxes that hold all changed buckets, whether they hold no others); None if ids are no numbers, as those
    of null values. At most ``LISTED`` ids reach the driver."""
    pattern = "^" + "-".join(["(-?[0-9]+)"] * len(dims)) + "$"
    ids = changed.select(*[F.regexp_extract("_bucket", pattern, k + 1).try_cast("bigint").alias(f"i{k}") for k in range(len(dims))])
    some = [tuple(r) for r in ids.limit(LISTED + 1).collect()]
    if any(None in cell for cell in some):
        return None
    if len(some) <= LISTED:
        if len(exact := boxes(some)) <= RANGES:
            return exact, True
        return [tuple((min(i), max(i)) for i in zip(*some, strict=True))], False
    *limits, unclear = ids.agg(*[f(f"i{k}") for k in range(len(dims)) for f in (F.min, F.max)], F.count_if(F.col("i0").isNull())).first()
    return None if unclear else ([tuple(zip(limits[::2], limits[1::2], strict=True))], False)


def _within(d: Dimension, first: int, last: int) -> Column:
    """A condition on a column that rows of some buckets meet. For hex texts, which may be in either case, it is
    on their first digit."""
    column = F.col(d.column)
    if d.kind == "int":
        return (column >= F.lit(first * d.step + d.offset).cast("long")) & (column < F.lit((last + 1) * d.step + d.offset).cast("long"))
    start, end = bounds(d, F.lit(first))[0], bounds(d, F.lit(last))[1]
    if d.kind != "hex":
        return (column >= start) & (column < end)
    digits = range(first * d.step >> 28, min(15, (last + 1) * d.step - 1 >> 28) + 1)
    cases = [column.cast("string").startswith(c) for i in digits for c in sorted({f"{i:x}", f"{i:X}"})]
    return reduce(or_, cases, F.lit(False)) if len(digits) < 16 else F.lit(True)


def within_buckets(df: DataFrame, dims: list[Dimension], changed: DataFrame) -> DataFrame:
    """Rows of the buckets of ``changed`` (_bucket). Buckets of numbers, times and hex texts, in any number of
    dimensions, become boxes of ranges, and few buckets of values a list; these reach the scan. What they do not tell
    exactly, a semi-join does."""
    exact = False
    if all(d.kind != "value" for d in dims) and (found := _boxes_of(changed, dims)) is not None:
        some, exact = found
        cases = [reduce(and_, [_within(d, *span) for d, span in zip(dims, box, strict=True)]) for box in some]
        df, exact = df.where(reduce(or_, cases, F.lit(False))), exact and all(d.kind != "hex" for d in dims)
    elif len(dims) == 1 and dims[0].kind == "value":
        kind = df.schema[dims[0].column].dataType
        few = [r[0] for r in changed.select(F.col("_bucket").try_cast(kind)).distinct().limit(VALUES + 1).collect()]
        if len(few) <= VALUES:  # a null value has an empty id
            df = df.where(F.col(dims[0].column).isin([v for v in few if v is not None]) | F.col(dims[0].column).isNull())
    return df if exact else df.withColumn("_bucket", partition_id(dims)).join(changed.select("_bucket"), "_bucket", "left_semi").drop("_bucket")


def hash_changes(
    src: DataFrame, dst: DataFrame, dims: list[Dimension], keys: list[str], hashed: list[str], refresh: bool = False, skip_row_count: bool = False
) -> DataFrame:
    """Changed rows with change_type, found in two phases: bucket hashes of both sides tell which
    buckets differ, and only their rows are read again and compared. The first phase runs at once; which
    buckets differ is written down.

    refresh: rows of a changed bucket in which the source has as many rows as the destination or more
    are all taken over as M (A in new buckets, if the destination has no row of the key), without being
    compared; keys that only the destination has come out as D. A row that moved to another bucket is one
    change, as both buckets are changed. Either side is read once.
    """
    sides = [bucket_hashes(x, dims, hashed, digits=DIGITS) for x in (src, dst)]
    changed = bucket_diff(*sides, skip_row_count).where("status <> 'N'")
    # names that no table has
    ids = saved(changed.select(F.col("partition_id").alias("_bucket"), F.col("status").alias("_status"), F.col("count_diff").alias("_more")))
    if not refresh:
        return row_diff(within_buckets(src, dims, ids), within_buckets(dst, dims, ids), keys, hashed)
    columns = src.columns
    there = within_buckets(src, dims, ids).withColumn("_bucket", partition_id(dims)).join(ids, "_bucket").select(*columns, "_status", "_more").alias("s")
    before = within_buckets(dst, dims, ids).select(*columns).withColumn("_there", F.lit(True)).alias("d")
    both = there.join(before, reduce(and_, [F.col(f"s.{k}") == F.col(f"d.{k}") for k in keys]), "full_outer")
    new, old = F.col("s._status").isNotNull(), F.col("d._there").isNotNull()
    same = reduce(and_, [F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}")) for c in hashed], F.lit(True))
    taken = F.when(old, "M").otherwise(F.col("s._status"))  # buckets that are read are A or M where the source has rows
    kind = F.when(~new, "D").when((F.col("s._status") == "A") | (F.col("s._more") >= 0), taken).otherwise(F.when(~old, "A").when(~same, "M"))
    out = [F.when(new, F.col(f"s.{c}")).otherwise(F.col(f"d.{c}")).alias(c) for c in columns]
    return both.select(*out, kind.alias("change_type")).where("change_type IS NOT NULL")


def orphans(src: DataFrame, dst: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only the destination has."""
    return dst.select(*keys).join(src.select(*keys), keys, "left_anti")


def drill(src: DataFrame, dst: DataFrame, levels: list[list[Dimension]], hashed: list[str], page_size: int, digits: int = 8) -> DataFrame:
    """Bucket diffs by levels: buckets that are A or M and hold more than ``page_size`` rows give way to
    their buckets at the next level. Columns: level and those of ``bucket_diff``; ids follow the
    parent's. Each level reads only the rows of the buckets that were large above."""
    out, parents = None, None
    for level, dims in enumerate(levels):
        outer = [d for ds in levels[:level] for d in ds]

        def scoped(df: DataFrame, outer: list[Dimension] = outer, parents: DataFrame | None = parents) -> DataFrame:
            return df if parents is None else df.withColumn("_p", partition_id(outer)).join(parents, "_p", "left_semi")

        found = bucket_diff(*[bucket_hashes(scoped(x), dims, hashed, outer=outer, digits=digits) for x in (src, dst)])
        found = found.withColumn("level", F.lit(level))
        large = (F.col("num_rows") > page_size) & F.col("status").isin("A", "M") if level < len(levels) - 1 else F.lit(False)
        done = found.where(~large)
        out = done if out is None else out.unionByName(done)
        parents = found.where(large).select(F.col("partition_id").alias("_p"))
    return out


def drill_changes(src: DataFrame, dst: DataFrame, levels: list[list[Dimension]], keys: list[str], hashed: list[str], page_size: int) -> DataFrame:
    """Changed rows with change_type, of the buckets that ``drill`` ends with: small ones at a coarse level,
    parts of large ones at finer levels. Which buckets differ is written down first."""
    changed = saved(drill(src, dst, levels, hashed, page_size, DIGITS).where("status <> 'N'").select(F.col("level").alias("_level"), F.col("partition_id").alias("_bucket")))

    def within(df: DataFrame) -> DataFrame:
        parts = []
        for level, dims in enumerate(levels):
            outer = [d for ds in levels[:level] for d in ds]
            at = changed.where(F.col("_level") == level).select("_bucket")
            parts.append(df.withColumn("_bucket", partition_id(dims, outer)).join(at, "_bucket", "left_semi").drop("_bucket") if outer else within_buckets(df, dims, at))
        return reduce(DataFrame.unionByName, parts)  # a row is in one of the buckets at most

    return row_diff(within(src), within(dst), keys, hashed)


def summary(diff: DataFrame) -> DataFrame:
    """Buckets and rows per status."""
    return diff.groupBy("status").agg(F.count("*").alias("partitions"), F.sum("num_rows").alias("num_rows"))
