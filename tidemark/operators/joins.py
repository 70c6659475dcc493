"""Joins with dimensions: lookups, as-of and validity intervals, and key sets.

Sides are never broadcast by hand: Spark broadcasts a side that its statistics show to be small, and
otherwise shuffles and splits skewed keys at run time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, DateType, LongType, NumericType, StructField, StructType, TimestampNTZType, TimestampType
from pyspark.sql.window import WindowSpec

from tidemark.functions.buckets import floor_div, unit_index
from tidemark.plans.bounds import extremes
from tidemark.work import saved


def chain(base: DataFrame, joins: list[tuple[DataFrame, Column | list[str], str]]) -> DataFrame:
    return reduce(lambda df, j: df.join(j[0], j[1], j[2]), joins, base)


def first_per_key(dim: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order, by an aggregation that is combined before its
    shuffle."""
    rank = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    rows = dim.select(*[F.col(k) for k in keys], F.struct(*rank, F.struct(*[F.col(c) for c in dim.columns if c not in keys]).alias("_row")).alias("_r"))
    best = rows.groupBy(*keys).agg(F.min("_r").alias("_r"))
    return best.select(*keys, *[F.col(f"_r._row.{c}").alias(c) for c in dim.columns if c not in keys])


def _fetched(left: DataFrame, dim: DataFrame, keys: list[str], fetch: dict[str, str] | None) -> dict[str, str]:
    """Dimension column to result name: the given ones, or all but keys; columns that the left side has
    stay its own."""
    wanted = fetch or {c: c for c in dim.columns if c not in keys}
    return {c: n for c, n in wanted.items() if n not in left.columns}


def lookup(left: DataFrame, dim: DataFrame, on: dict[str, str], how: str = "left", many: bool = False, order: list[Column] | None = None, fetch: dict[str, str] | None = None) -> DataFrame:
    """Columns of a dimension by key. ``on``: left column to dimension column; ``many``: all matches,
    else the first per key in ``order``; ``fetch``: dimension column to result name."""
    keys = list(on.values())
    take = _fetched(left, dim, keys, fetch)
    if not many:
        if not order:
            raise ValueError("a lookup of one row needs an order")
        dim = first_per_key(dim, keys, order)
    right = dim.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(n) for c, n in take.items()])
    on_ = reduce(and_, [left[c] == right[f"_k{i}"] for i, c in enumerate(on)])
    return left.join(right, on_, how).select(*[left[c] for c in left.columns], *take.values())


def lookup_rows(left: DataFrame, dim: DataFrame, on: dict[str, str]) -> DataFrame:
    """The dimension's rows that the left side refers to, apart from it."""
    keys = left.select(*[F.col(c).alias(k) for c, k in on.items()]).distinct()
    return dim.join(keys, list(on.values()), "left_semi")


def enrich(left: DataFrame, dim: DataFrame, on: dict[str, str], fields: dict[str, str], order: list[Column]) -> DataFrame:
    """A lookup whose fields are SQL expressions over the dimension; null where there is no match."""
    keys = list(on.values())
    return lookup(left, dim.select(*keys, *[F.expr(e).alias(n) for n, e in fields.items()]), on, order=order)


#: Rows of a key that one task sorts; keys of more rows are divided by time. They are looked for only in inputs of
#: more than so many bytes, by Spark's estimate. Cut times that are broadcast, at most.
HOT_ROWS, COUNTED_BYTES, BROADCAST_CUTS = 1_000_000, 256 << 20, 500_000
#: Tasks that rows without a key or time, which match nothing, are spread over.
_VOID = 64

Slices = int | tuple[int, str]


def _slice_of(column: Column, slices: Slices) -> Column:
    """The slice of time that a value is in: a step of numbers, or (step, unit) of times."""
    return floor_div(column, slices) if isinstance(slices, int) else floor_div(unit_index(column, slices[1]), slices[0])


def _keyed(df: DataFrame, keys: list[str], time: str, *columns: Column) -> DataFrame:
    """Keys as _k0, _k1, ..., time as _t, and other columns. Rows that lack a key or the time, which no
    other row can match, have numbers of their own in _void."""
    plain = [f.name for f in df.schema if isinstance(f.dataType, AtomicType)]
    lacks = reduce(or_, [F.col(c).isNull() for c in [*keys, time]])
    void = F.when(lacks, 1 + F.pmod(F.xxhash64(*plain), F.lit(_VOID))).otherwise(0).cast("int")
    return df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], void.alias("_void"), F.col(time).alias("_t"), *columns)


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _cuts(parts: list[DataFrame], by: list[str]) -> tuple[DataFrame, int] | None:
    """(by, _cuts) of keys of very many rows in all ``parts`` together: times that divide each into slices of about
    ``HOT_ROWS``, and how many there are at most. None if there is no such key. Counts are exact; cuts are
    quantiles from a sketch that is combined before its shuffle."""
    kind = parts[0].schema["_t"].dataType
    if not isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType)) or sum(map(_bytes, parts)) < COUNTED_BYTES:
        return None
    times = reduce(DataFrame.unionByName, [p.select(*by, "_t") for p in parts]).where("_void = 0")
    heavy = saved(times.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS))
    n, most = heavy.agg(F.count("*"), F.max("_n")).first()
    if not n:
        return None
    slices = min(10_000, -(-most // HOT_ROWS))
    at = F.percentile_approx("_t", [i / slices for i in range(1, slices)], 10 * slices)
    cuts = saved(times.join(heavy.select(*by), by, "left_semi").groupBy(*by).agg(F.array_distinct(at).alias("_cuts")))
    return (F.broadcast(cuts) if n * slices <= BROADCAST_CUTS else cuts), slices


def _slice_at(cuts: Column, time: Column, most: int) -> Column:
    """How many of the sorted ``cuts`` are at ``time`` or before, by binary search; 0 without cuts."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= time, at + step).otherwise(at))


def _divided(parts: list[DataFrame], by: list[str], slices: Slices | None, *more: str) -> list[DataFrame] | None:
    """``parts`` with the _slice of time that a row is in: the given ones (a step of numbers, or (step, unit) of
    times), else those of keys of very many rows, or None. ``more``: other columns of time, whose slice
    comes as _slice<column>."""
    if slices is not None:
        return [p.withColumns({"_slice": _slice_of(F.col("_t"), slices), **{f"_slice{c}": _slice_of(F.col(c), slices) for c in more}}) for p in parts]
    if (found := _cuts(parts, by)) is None:
        return None
    cuts, most = found

    def numbered(p: DataFrame) -> DataFrame:
        p = p.join(cuts, by, "left")
        ends = {f"_slice{c}": _slice_at(F.col("_cuts"), F.col(c), most) for c in more}
        return p.withColumns({"_slice": _slice_at(F.col("_cuts"), F.col("_t"), most), **ends}).drop("_cuts")

    return [numbered(p) for p in parts]


def asof(
    left: DataFrame, dim: DataFrame, keys: list[str], ts: str, valid_from: str, operator: str = "<=", fetch: dict[str, str] | None = None, tie: str | None = None, slices: Slices | None = None,
) -> DataFrame:
    """Left as-of join: for ``<=`` and ``<``, the latest dimension row whose valid_from is at or before
    (before) ts; for ``>=`` and ``>``, the earliest at or after (after). Among equal times, the
    greatest ``tie`` wins backwards and the least forwards. As in SQL, a null key or time matches nothing, on
    either side.

    One pass over both sides, united and sorted per key: no pair of rows is formed. A key of very many
    rows is divided by time at quantiles into many tasks; a slice starts with the row that the slices before it
    end with. ``slices``, a step of numbers or (step, unit) of times, divides all keys alike instead.
    """
    if operator not in ("<=", "<", ">=", ">"):
        raise ValueError(f"unknown operator: {operator}")
    take = _fetched(left, dim, [*keys], fetch)
    back, inclusive = operator[0] == "<", operator.endswith("=")
    names = left.columns
    by = [*[f"_k{i}" for i in range(len(keys))], "_void"]
    tie_ = F.col(tie) if tie else F.lit(0)
    rows = _keyed(left, keys, ts, F.lit(1 if inclusive else -1).alias("_side"), F.lit(None).cast(dim.schema[tie].dataType if tie else "int").alias("_tie"), F.struct(*names).alias("_left"))
    facts = _keyed(dim, keys, valid_from, F.lit(0).alias("_side"), tie_.alias("_tie"), F.struct(*[F.col(c).alias(n) for c, n in take.items()]).alias("_right")).where("_void = 0")
    if (divided := _divided([rows, facts], by, slices)) is not None:
        rows, facts = divided
        facts = facts.unionByName(_carried(rows, facts, by, back))
        by = [*by, "_slice"]
    both = rows.unionByName(facts, allowMissingColumns=True)
    order = [F.col("_t").asc_nulls_first(), "_side", F.col("_tie").asc_nulls_first()] if back else [F.col("_t").desc_nulls_first(), "_side", F.col("_tie").desc_nulls_first()]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_right", ignorenulls=True).over(w)).where(F.col("_left").isNotNull())
    return found.select("_left.*", *[F.col(f"_found.{n}").alias(n) for n in take.values()])


def _carried(rows: DataFrame, facts: DataFrame, by: list[str], back: bool) -> DataFrame:
    """For each key and slice that has rows, the fact that the slices before it (after it, if not ``back``)
    end with, put before all others of the slice (its time is null). One row per key and slice is
    sorted, whatever their sizes."""
    end = (F.max_by if back else F.min_by)(F.struct("_tie", "_right"), F.struct("_t", "_tie"))
    carried = _before(rows, facts, by, end, back, lambda ends, w: F.last(ends, ignorenulls=True).over(w))
    return carried.select(*by, F.lit(None).cast(facts.schema["_t"].dataType).alias("_t"), F.lit(0).alias("_side"), F.col("_carry._tie").alias("_tie"), F.col("_carry._right").alias("_right"), "_slice")


def _before(rows: DataFrame, facts: DataFrame, by: list[str], end: Column, back: bool, over: Callable[[str, WindowSpec], Column]) -> DataFrame:
    """(by, _slice, _carry) of slices that have rows: what ``over`` makes of the ``end`` of each slice before
    them (after them, if not ``back``)."""
    ends = facts.groupBy(*by, "_slice").agg(end.alias("_end"))
    slices = rows.where("_void = 0").select(*by, "_slice").withColumn("_asked", F.lit(True)).distinct()
    both = slices.unionByName(ends, allowMissingColumns=True).groupBy(*by, "_slice").agg(F.max("_asked").alias("_asked"), F.first("_end", ignorenulls=True).alias("_end"))
    order = F.col("_slice").asc() if back else F.col("_slice").desc()
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("_carry", over("_end", before)).where(F.col("_asked") & F.col("_carry").isNotNull()).select(*by, "_slice", "_carry")


def asof_pruned(left: DataFrame, dim: DataFrame, keys: list[str], ts: str, valid_from: str, fetch: dict[str, str] | None = None, tie: str | None = None) -> DataFrame:
    """``asof`` with <=, after dropping dimension rows that cannot win: those after the last event, which the
    dimension's scan does not read, and per key those before the last one that precedes the first event."""
    limits = extremes(left, ts)
    if limits is None:
        return asof(left, dim.limit(0), keys, ts, valid_from, "<=", fetch, tie)
    first, last = limits
    within = dim.where(F.col(valid_from) <= last)
    start = within.where(F.col(valid_from) <= first).groupBy(*keys).agg(F.max(valid_from).alias("_from"))
    kept = within.join(start, keys, "left").where(F.col("_from").isNull() | (F.col(valid_from) >= F.col("_from"))).select(*dim.columns)
    return asof(left, kept, keys, ts, valid_from, "<=", fetch, tie)


def require_disjoint(dim: DataFrame, keys: list[str], valid_from: str, valid_to: str) -> None:
    """Raises ValueError if two intervals of a key overlap; one row reaches the driver."""
    rows = dim.where(reduce(and_, [F.col(c).isNotNull() for c in [*keys, valid_from]]) & (F.col(valid_to).isNull() | (F.col(valid_from) < F.col(valid_to))))
    follows = F.lead(valid_from).over(Window.partitionBy(*keys).orderBy(valid_from))
    if not rows.select(follows.alias("_next"), F.col(valid_to).alias("_to")).where("_next IS NOT NULL AND (_to IS NULL OR _next < _to)").isEmpty():
        raise ValueError(f"intervals of {keys} overlap")


def scd(
    left: DataFrame, dim: DataFrame, keys: list[str], ts: str, valid_from: str, valid_to: str, operator: str = "<=", open_ended: bool = True, overlapping: bool = True,
    fetch: dict[str, str] | None = None, tie: str | None = None, slices: Slices | None = None, check: bool = False,
) -> DataFrame:
    """Left join with validity intervals: valid_from <= t < valid_to, where a null valid_to is open and
    matches only if ``open_ended``; of overlapping intervals the latest valid_from wins, then the greatest
    ``tie``. Operators >= and > are reversed: valid_from >= t (> t) and t < valid_to. < acts as <=. Null keys,
    times and valid_from match nothing.

    No pairs are formed. Intervals become the points at which the best of them changes, and rows find theirs by
    ``asof``. Without ``overlapping`` the caller knows that no two intervals of a key overlap (``check`` makes
    sure), and the starts of intervals are these points. Reversed, an interval never ceases to match as t
    falls, so the best so far is a running maximum. Keys of very many rows are divided by time in all of this.
    """
    take = _fetched(left, dim, keys, fetch)
    right = dim if open_ended else dim.where(F.col(valid_to).isNotNull())
    if operator in ("<", "<=") and not overlapping:
        if check:
            require_disjoint(right, keys, valid_from, valid_to)
        right = right.where(F.col(valid_to).isNull() | (F.col(valid_from) < F.col(valid_to)))
        points = right.select(*keys, F.col(valid_from).alias("_t"), F.col(valid_to).alias("_to"), (F.col(tie) if tie else F.lit(0)).alias("_tie"), F.struct(*[F.col(c).alias(n) for c, n in take.items()]).alias("_hit"))
        joined = asof(left, points, keys, ts, "_t", "<=", {"_hit": "_hit", "_to": "_to"}, "_tie", slices)
        holds = F.col("_to").isNull() | (F.col(ts) < F.col("_to"))
        return joined.select(*left.columns, *[F.when(holds, F.col(f"_hit.{n}")).alias(n) for n in take.values()])
    by = [*[f"_k{i}" for i in range(len(keys))], "_void"]
    fact = [F.col(valid_to).alias("_to"), (F.col(tie) if tie else F.lit(0)).alias("_tie"), F.struct(*[F.col(c).alias(n) for c, n in take.items()]).alias("_right")]
    facts = _keyed(right, keys, valid_from, *fact).where("_void = 0")
    if operator[0] == "<":
        points = _change_points(facts, by, slices)
        renamed = points.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.col("_at").alias("_t"), "_n", F.col("_right").alias("_hit"))
        joined = asof(left, renamed, keys, ts, "_t", "<=", {"_hit": "_hit"}, "_n", slices)
        return joined.select(*left.columns, *[F.col(f"_hit.{n}").alias(n) for n in take.values()])
    rows = _keyed(left, keys, ts, F.struct(*left.columns).alias("_left"))
    found = _best_after(rows, facts, by, operator == ">", slices)
    return found.select("_left.*", *[F.col(f"_found.{n}").alias(n) for n in take.values()])


def _best_after(rows: DataFrame, facts: DataFrame, by: list[str], strict: bool, slices: Slices | None) -> DataFrame:
    """_left and _found: of the intervals that start at t or after (after, if ``strict``) and end after t, the
    one that starts last."""
    # an interval matches every t up to its start, and below its end if that is not after its start
    early = F.coalesce(F.col("_to") <= F.col("_t"), F.lit(False))
    facts = facts.select(*by, F.when(early, F.col("_to")).otherwise(F.col("_t")).alias("_t"), F.when(early | F.lit(strict), 2).otherwise(0).alias("_side"), F.struct(F.col("_t").alias("_from"), "_tie", "_right").alias("_best"))
    rank = lambda c: F.when(F.col(c).isNotNull(), F.struct(f"{c}._from", f"{c}._tie"))
    if (divided := _divided([rows, facts], by, slices)) is not None:
        rows, facts = divided
        carried = _before(rows, facts, by, F.max_by("_best", rank("_best")), False, lambda ends, w: F.max_by(ends, rank(ends)).over(w))
        facts = facts.unionByName(carried.select(*by, F.lit(None).cast(facts.schema["_t"].dataType).alias("_t"), F.lit(0).alias("_side"), F.col("_carry").alias("_best"), "_slice"))
        by = [*by, "_slice"]
    both = rows.withColumn("_side", F.lit(1)).unionByName(facts, allowMissingColumns=True)
    # within one time: intervals that match it, the rows, intervals that match only below it
    w = Window.partitionBy(*by).orderBy(F.col("_t").desc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.max_by(F.col("_best._right"), rank("_best")).over(w)
    return both.withColumn("_found", best).where(F.col("_left").isNotNull()).select("_left", "_found")


def _change_points(facts: DataFrame, by: list[str], slices: Slices | None) -> DataFrame:
    """(by, _at, _n, _right): from _at on, until the next point of the key, the best of the intervals of ``facts``
    that hold is _right, or there is none; of points of one time the one with the greatest _n counts.

    Intervals stream by in the order of their start, key by key; held are those that may be the best when others
    have ended, of which each ends before those that it came after. In a slice of time, what started before it is
    there from the beginning, as far as it may be the best in it: intervals that end in this slice,
    each in one slice only, and of those that last longer than it the best one.
    """
    common = facts.select(F.coalesce("_t", "_to").alias("x")).schema["x"].dataType
    facts = facts.withColumns({c: F.col(c).cast(common) for c in ("_t", "_to")})
    facts = facts.where(F.col("_to").isNull() | (F.col("_t") < F.col("_to"))).withColumn("_from", F.col("_t"))
    if (divided := _divided([facts], by, slices, "_to")) is None:
        begun = facts.withColumns({"_slice": F.lit(0), "_ends": F.col("_to").isNotNull()})
    else:
        (own,) = divided
        longer = own.where(F.col("_to").isNull() | (F.col("_slice_to") > F.col("_slice")))
        unknown = F.lit(None).cast(own.schema["_t"].dataType).alias("_t")
        columns = [*by, "_slice", "_t", "_from", "_to", "_tie", "_right", "_ends"]
        ending = longer.where("_to IS NOT NULL").drop("_slice", "_t").withColumnRenamed("_slice_to", "_slice").withColumn("_ends", F.lit(True)).select(*by, "_slice", unknown, *columns[-5:])
        at_start = own.withColumn("_ends", F.coalesce(F.col("_slice_to") == F.col("_slice"), F.lit(False)) & F.col("_to").isNotNull()).select(*columns)
        covering = _covering(own, longer, by).withColumn("_ends", F.lit(False)).select(*by, "_slice", unknown, *columns[-5:])
        begun = at_start.unionByName(ending).unionByName(covering)
    sorted_ = begun.repartition(*by, "_slice").sortWithinPartitions(*by, "_slice", F.col("_t").asc_nulls_first(), "_from", F.col("_tie").asc_nulls_first())
    rows = sorted_.select(F.struct(*by).alias("_by"), "_slice", "_t", "_to", "_ends", "_right")
    schema = StructType([rows.schema["_by"], StructField("_at", rows.schema["_t"].dataType), StructField("_n", LongType()), StructField("_right", rows.schema["_right"].dataType)])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, points, number = None, [], [], count()

        def point(at: object) -> None:
            points.append((here[0], at, next(number), held[-1][1].as_py() if held else None))

        def close(upto: object) -> None:
            """Ends intervals that have ended by a time, or all that end in the slice."""
            while held and (held[-1][2] if upto is None else held[-1][0] is not None and held[-1][0] <= upto):
                at = held.pop()[0]
                point(at)

        def batch_of(points: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
            columns = zip(*points, strict=True) if points else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], names=schema.names)

        arrow = None
        for batch in batches:
            arrow = arrow or pa.schema([("_by", batch.schema.field("_by").type), ("_at", batch.schema.field("_t").type), ("_n", pa.int64()), ("_right", batch.schema.field("_right").type)])
            for of, part, t, to, ends, fact in zip(*[c.to_pylist() for c in batch.columns[:5]], batch.column(5), strict=True):
                if here is None or (of, part) != here:
                    close(None)
                    here = (of, part)
                    held.clear()
                if t is not None:
                    close(t)
                while held and (to is None or held[-1][0] is not None and held[-1][0] <= to):
                    held.pop()  # it starts before this one and ends no later
                held.append((to, fact, ends))
                if t is not None:
                    point(t)
            yield batch_of(points, arrow)
            points.clear()
        if here is not None:
            close(None)
            yield batch_of(points, arrow)

    return rows.mapInArrow(sweep, schema).select("_by.*", "_at", "_n", "_right")


def _covering(own: DataFrame, longer: DataFrame, by: list[str]) -> DataFrame:
    """For each slice that has intervals or ends of them, the best of those that start before and end after it."""
    rank = F.struct("_from", "_tie")
    last = own.select(*by, F.greatest("_slice", F.when(F.col("_to").isNotNull(), F.col("_slice_to"))).alias("_s")).groupBy(*by).agg(F.max("_s").alias("_end"))
    beyond = longer.join(last, by).withColumn("_b", F.when(F.col("_to").isNull(), F.col("_end") + 1).otherwise(F.col("_slice_to"))).where("_b > _slice + 1")
    pairs = beyond.groupBy(*by, "_slice", "_b").agg(F.max_by(F.struct("_from", "_to", "_tie", "_right"), rank).alias("_best"))
    of_start = Window.partitionBy(*by, "_slice")
    # of those that start in one slice, the best that last up to _b or longer covers the slices before it
    best = F.max_by("_best", F.struct("_best._from", "_best._tie")).over(of_start.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stairs = pairs.withColumns({"_most": best, "_from_slice": F.coalesce(F.lag("_b").over(of_start.orderBy("_b")), F.col("_slice") + 1)})
    covered = stairs.select(*by, F.explode(F.sequence("_from_slice", F.col("_b") - 1)).alias("_covered"), F.col("_slice").alias("_started"), "_most")
    return covered.groupBy(*by, F.col("_covered").alias("_slice")).agg(F.max_by("_most", "_started").alias("_m")).select(*by, "_slice", "_m.*")
