"""Sharding by sampled splitters, in DataFrame operations only.

Rows have an order: by a hash of their text, so that equal texts are neighbours, then by id. A sample
of keys, weighted by size, gives quantile boundaries that cut this order into many more ranges than
there are shards; the ranges are measured, and those that are overfull are sampled again by
themselves and subdivided, inside one text's rows too, where these are many. Each range is then
sorted by one task, what lies before it is a sum over ranges, and so every row knows the bytes and rows
before it in all: shards are cut where the bytes before a row pass the next multiple of a shard's
share. The splitters decide who sorts what, never the result.

A range is found by binary search in arrays of splitters, which are literals of the plan: 16 for each
shard, or one for a million rows.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, text_of, unused

SHARDS = 40
#: Bytes that a row costs besides its text.
OVERHEAD = 16
#: Equal texts stay together unless they are more than this part of a shard's bytes or rows.
WHOLE = 64
RANGES_PER_SHARD = 16
ROWS_PER_RANGE = 1_000_000
SAMPLES_PER_RANGE = 32
_LEAST = -(1 << 63)

Splitter = tuple[int, int, int]  # key, id and number of the first row of a range


def _records(docs: DataFrame, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("key"),
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
    ).withColumn("id", F.coalesce("doc_id", F.lit(_LEAST)))


def _literal(values: list[int]) -> Column:
    """An array of numbers as one literal string, which is folded when the plan is made."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(splitters: list[Splitter]) -> Column:
    """How many splitters a row is not below, by binary search."""
    if not splitters:
        return F.lit(0)
    keys, ids, rows = map(_literal, map(list, zip(*splitters, strict=True)))

    def passed(i: Column) -> Column:  # null beyond the end, which counts as no
        key, id_, row = F.get(keys, i), F.get(ids, i), F.get(rows, i)
        return (key < F.col("key")) | ((key == F.col("key")) & ((id_ < F.col("id")) | ((id_ == F.col("id")) & (row <= F.col("row")))))

    steps = _literal([1 << k for k in reversed(range(len(splitters).bit_length()))]).cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(passed(at + step - 1), at + step).otherwise(at))


def _weight(n: int, total: int) -> Column:
    """A row's share of all bytes and of all rows, half and half: ranges are even in both."""
    return F.col("size") / F.lit(2.0 * total) + F.lit(0.5 / n)


def _sampled(rows: DataFrame, weight: Column, goal: float, heavy: set[int], seed: int) -> list[Splitter]:
    """Splitters about every ``goal`` of weight, from a sample with chances by weight. The rows of one key
    are divided only if it is heavy."""
    unit = goal / SAMPLES_PER_RANGE
    chance = F.pmod(F.xxhash64("row", "id", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    sample = sorted((k, i, r, w) for k, i, r, w in rows.withColumn("w", weight).where(chance < F.col("w") / unit).select("key", "id", "row", "w").collect())
    found, reached, upto = [], 0.0, goal
    for k, i, r, w in sample:
        if reached >= upto:
            found.append((k, i, r) if k in heavy else (k, _LEAST, _LEAST))
            upto = reached + goal
        reached += max(w, unit)
    return found


def _splitters(rows: DataFrame, n: int, total: int, shards: int, ranges: int) -> tuple[list[Splitter], list[tuple[int, int]], set[int]]:
    """Splitters, the (bytes, rows) of each of their ranges, and the keys whose rows may be divided."""
    weight, goal, heavy = _weight(n, total), 1 / ranges, set()
    splitters = sorted(set(_sampled(rows, weight, goal, heavy, 0)))
    tried: set[Splitter | None] = set()
    seed = 0
    while True:
        measured = {r: (size, count) for r, size, count in rows.groupBy(_range_of(splitters).alias("range")).agg(F.sum("size"), F.count("*")).collect()}
        sizes = [measured.get(r, (0, 0)) for r in range(len(splitters) + 1)]
        over = [r for r, (size, count) in enumerate(sizes) if size / (2 * total) + count / (2 * n) > 2 * goal]
        # a range that begins as before and could not be divided then is one text's rows
        over = [r for r in over if (splitters[r - 1] if r else None, *sizes[r]) not in tried]
        if not over:
            return splitters, sizes, heavy
        tried |= {(splitters[r - 1] if r else None, *sizes[r]) for r in over}
        seed += 1
        inside = rows.where(F.array_contains(_literal(over), _range_of(splitters).cast("long")))
        heavy |= {k for (k,) in inside.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where(_divided("size", "n", n, total, shards)).select("key").collect()}
        splitters = sorted({*splitters, *_sampled(inside, weight, goal, heavy, seed)})


def _divided(size: str, count: str, n: int, total: int, shards: int) -> Column:
    parts = F.lit(shards * WHOLE)
    return (F.col(size) * parts > total) | (F.col(count) * parts > n)


def placements(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, ranges: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `bytes`: shard k holds the rows whose middle byte, in the order of (hash of text, id), falls into the
    k-th of ``shards`` equal parts, so sizes differ from equal by at most one row's size, or the
    ``WHOLE``-th part of a shard: rows of equal texts go by the middle of them all, into one shard, unless
    they are more than this part of a shard's bytes or rows. Slots count from 0 in each shard, without gaps.
    Null texts are empty ones (size 16, checksum 0); null ids come before others; rows that repeat id and text
    are neighbours in any order. An empty table gives no rows; other columns are ignored; fewer rows than shards leave shards empty.

    row_col: a column that is unique and never null; it comes first in the result, as row.
    ranges: how many ranges to sort in, more by default the more rows there are.
    """
    rows = durable(_records(docs, id_col, text_col, row_col))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(1))).first()
    ranges = ranges or max(RANGES_PER_SHARD * shards, -(-n // ROWS_PER_RANGE))
    splitters, sizes, heavy = _splitters(rows, max(1, n), total, shards, ranges)
    before = [(0, 0), *accumulate(sizes, lambda a, b: (a[0] + b[0], a[1] + b[1]))]
    at = F.col("range")
    in_range = Window.partitionBy("range").orderBy("key", "id", "row")
    of_text = Window.partitionBy("range", "key")
    ordered = (
        rows.withColumn("range", _range_of(splitters))
        .withColumn("upto", F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.get(_literal([b for b, _ in before]), at))
        .withColumn("place", F.row_number().over(in_range) - 1 + F.get(_literal([c for _, c in before]), at))
        .withColumn("same_size", F.sum("size").over(of_text))
        .withColumn("same", F.count("*").over(of_text))
        .withColumn("first", F.min(F.col("upto") - F.col("size")).over(of_text))
    )
    # heavy keys may be spread over ranges, where their parts need not be many
    single = _divided("same_size", "same", n, total, shards) | F.array_contains(_literal(sorted(heavy) or [-1]), F.col("key"))
    middle = F.when(single, 2 * F.col("upto") - F.col("size")).otherwise(2 * F.col("first") + F.col("same_size"))
    unique = ["row"] if row_col else []
    cut = ordered.withColumn("middle", middle).withColumn("shard", F.expr(f"CAST(least({shards - 1}, middle * {shards} div {2 * total}) AS INT)"))
    placed = durable(cut.select(*unique, "doc_id", "size", "text_crc32", "shard", "place"))
    starts = dict(placed.groupBy("shard").agg(F.min("place")).collect())
    slot = F.col("place") - F.get(_literal([starts.get(s, 0) for s in range(shards)]), F.col("shard"))
    return placed.select(*unique, "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, rows_per_file: int = ROWS_PER_RANGE, **names: str) -> None:
    """Writes ``docs``, all columns and rows, as Parquet with a folder ``shard=k`` for each shard, its rows
    ordered by slot over its files, which hold ``rows_per_file`` rows at most. A column of ``docs`` named
    shard or slot is an error, as the folder or column could not be told from it."""
    if clash := {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns that sharding writes itself: {sorted(clash)}")
    row, place, part = unused(docs.columns, "_row", "_place", "_part")
    numbered = durable(docs.withColumn(row, F.monotonically_increasing_id()))
    places = placements(numbered, shards, row_col=row, **names).select(F.col("row").alias(place), "shard", "slot")
    files = numbered.join(places, F.col(row) == F.col(place)).withColumn(part, F.floor(F.col("slot") / rows_per_file))
    files.repartition("shard", part).sortWithinPartitions("shard", "slot").drop(row, place, part).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


ORACLE = f"""
WITH c AS MATERIALIZED (  -- the checksum's table, from its polynomial
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END)) AS crc
), d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + {OVERHEAD} AS size, 
         CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS key,
         xor(list_reduce(list_prepend({0xFFFFFFFF}, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: CAST('0x' || h AS BIGINT))),
                         lambda s, b: xor(s >> 8, crc[CAST(xor(s, b) & 255 AS INTEGER) + 1])), {0xFFFFFFFF}) AS text_crc32
  FROM documents, c
), s AS (
  SELECT *, sum(size) OVER o AS upto, row_number() OVER o - 1 AS place,
         sum(size) OVER g AS same_size, count(*) OVER g AS same, sum(size) OVER () AS total, count(*) OVER () AS n
  FROM d WINDOW o AS (ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY key)
), m AS (
  SELECT *, CASE WHEN same_size * {SHARDS * WHOLE} > total OR same * {SHARDS * WHOLE} > n THEN 2 * upto - size
                 ELSE 2 * min(upto - size) OVER (PARTITION BY key) + same_size END AS middle
  FROM s
), p AS (SELECT *, CAST(least({SHARDS - 1}, middle * {SHARDS} // (2 * total)) AS INTEGER) AS shard FROM m)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""
