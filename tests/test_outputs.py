"""Planned files, digests in order, lossless types, and the refresh policy."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import diff as D
from tidemark.operators.digests import block_digests
from tidemark.operators.schema import common, evolve, holds
from tidemark.sources.writers import apply_changes, delete_by_keys, delete_insert, planned, rows_per_file, upsert, write_sized
from tidemark.spec import Dimension
from tidemark.work import folder, saved, scope


def test_files_are_joined_and_cut(spark, tmp_path):
    rows = spark.range(5003, numPartitions=31).selectExpr("id", "CASE WHEN id % 100 = 0 THEN 'D' WHEN id < 400 THEN 'A' WHEN id % 501 = 7 THEN NULL ELSE 'M' END AS change_type")
    write_sized(rows, f"{tmp_path}/out", 500)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 5003 and sorted(r.id for r in back.select("id").collect()) == list(range(5003))
    files = back.groupBy("change_type", F.input_file_name().alias("f")).count().collect()
    for kind in ("A", "D", "M", None):
        sizes = [r["count"] for r in files if r.change_type == kind]
        assert len(sizes) == math.ceil(sum(sizes) / 500) and max(sizes) - min(sizes) <= 1 and max(sizes) <= 500
    assert planned(rows.limit(0), 10)[1] == 0
    write_sized(rows.limit(0), f"{tmp_path}/none", 10)
    with pytest.raises(ValueError, match="either"):
        write_sized(rows, f"{tmp_path}/x")


def test_files_of_a_number_of_bytes(spark, tmp_path):
    rows = spark.range(60_000).selectExpr("id", "md5(CAST(id AS STRING)) AS x", "'M' AS change_type")
    assert rows_per_file(rows, 1 << 20) == pytest.approx((1 << 20) / 44, rel=0.3)
    write_sized(rows, f"{tmp_path}/out", target_bytes=1 << 20)
    sizes = [f.stat().st_size for f in (tmp_path / "out").rglob("*.parquet")]
    assert len(sizes) > 1 and all(0.4 * (1 << 20) < s < 1.2 * (1 << 20) for s in sizes)


def test_digests_stream(spark):
    dice = random.Random(2)
    rows = [(dice.choice([None, 1, 2, 3]), i, None if i % 9 == 0 else f"x{i % 50}é") for i in range(3000)] + [(7, 1, None), (8, 1, ""), (8, 2, "a")]
    dice.shuffle(rows)
    df = spark.createDataFrame(rows, "b int, i int, x string").repartition(5)
    for separator in ("", "|"):
        got = {r.block: (r.num_rows, r.hash) for r in block_digests(df, F.col("b"), F.col("x"), ["i"], separator).collect()}
        for b in (None, 1, 2, 3, 7, 8):
            texts = [x for _, x in sorted((i, x) for k, i, x in rows if k == b and x is not None)]
            want = hashlib.md5(separator.join(texts).encode()).hexdigest() if texts else None
            assert got[b] == (sum(k == b for k, _, _ in rows), want), (b, separator)
    assert block_digests(df.limit(0), F.col("b"), F.col("x"), ["i"]).isEmpty()


NUMBERS = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), *[T.DecimalType(p, s) for p, s in ((3, 0), (4, 2), (10, 0), (18, 4), (19, 0), (20, 0), (38, 0), (38, 18), (38, 38))]]


def extremes(t: T.DataType) -> list:
    match t:
        case T.DecimalType():
            return [Decimal((0, (9,) * t.precision, -t.scale)), Decimal((0, (1,), -t.scale)), Decimal((1, (9,) * t.precision, -t.scale))]
        case T.FloatType():
            return [0.1, 16777215.0, 3e38, 2.0**-140]
        case T.DoubleType():
            return [0.1, 9007199254740991.0, 1e300]
    bits = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}[t.simpleString()]
    return [2**bits - 1, -(2**bits), 1]


def test_no_value_is_lost_in_a_type_that_holds_another(spark):
    """All pairs of number types, by casting there and back."""
    for a in NUMBERS:
        df = spark.createDataFrame([(v,) for v in extremes(a)], T.StructType([T.StructField("v", a)])).cache()
        checks = [F.min(F.coalesce(F.col("v").try_cast(b).try_cast(a) == F.col("v"), F.lit(False)) & F.coalesce((F.col("v").try_cast(b).cast("string") == F.col("v").cast("string")) | F.lit(isinstance(b, (T.FloatType, T.DoubleType, T.DecimalType)) or isinstance(a, T.DecimalType)), F.lit(False))).alias(f"c{i}") for i, b in enumerate(NUMBERS)]
        kept = df.agg(*checks).first()
        for i, b in enumerate(NUMBERS):
            if holds(a, b):
                assert kept[i], (a, b)
    for a, b in itertools.product(NUMBERS, NUMBERS):
        c = common(a, b)
        assert c == common(b, a) or (c is not None and holds(a, c) and holds(b, c))
        assert c is None or (holds(a, c) and holds(b, c))
    assert not holds(T.IntegerType(), T.FloatType()) and not holds(T.LongType(), T.DoubleType()) and holds(T.IntegerType(), T.DoubleType())
    assert common(T.LongType(), T.DecimalType(10, 2)) == T.DecimalType(21, 2) and common(T.LongType(), T.DoubleType()) is None
    assert holds(T.StringType(), T.LongType()) is None


def test_lossy_changes_are_refused_or_lifted(spark):
    old = spark.createDataFrame([(16777217, 9007199254740993)], "i int, l bigint")
    for wanted in ("i float", "l double", "i smallint", "l decimal(5,0)"):
        with pytest.raises(ValueError, match="does not fit"):
            evolve(old, spark.createDataFrame([], wanted).schema)
    with pytest.raises(ValueError, match="l: bigint"):
        evolve(old, spark.createDataFrame([], "l double").schema, lift=True)
    lifted = evolve(old, spark.createDataFrame([], "i float, l decimal(5,2), n date").schema, lift=True)
    assert [f.dataType.simpleString() for f in lifted.schema] == ["double", "decimal(21,2)", "date"]
    assert tuple(lifted.first()) == (16777217.0, Decimal("9007199254740993.00"), None)


def test_moved_rows_are_one_change_and_sides_are_read_once(spark, tmp_path):
    before = [(i, i // 10, "a") for i in range(100)]
    after = [(i, (b + 5 if i % 10 == 3 else b + 20 if i % 30 == 4 else b), "b" if i == 7 else x) for i, b, x in before if i not in (20, 21, 22, 55)] + [(200, 1, "n"), (201, 90, "n")]
    for name, rows in (("src", after), ("dst", before)):
        spark.createDataFrame(rows, "id int, b int, x string").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    src, dst = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("src", "dst"))
    found = D.hash_changes(src, dst, [Dimension("b", 1)], ["id"], ["id", "b", "x"], refresh=True)
    rows = found.collect()
    assert len({r.id for r in rows}) == len(rows)
    assert {r.id for r in rows if r.change_type == "D"} == {20, 21, 22, 55} and {r.id for r in rows if r.change_type == "A"} >= {201}
    assert sorted(map(tuple, apply_changes(dst, found, ["id"]).collect())) == sorted(after)
    fresh = D.hash_changes(src, dst, [Dimension("b", 1)], ["id"], ["id", "b", "x"], refresh=True)
    plan = fresh._jdf.queryExecution().executedPlan().toString()  # not run yet: there is one plan, not a first and a final one
    assert plan.count(f"{tmp_path}/src") == plan.count(f"{tmp_path}/dst") == 1 and plan.count("FullOuter") == 1


def test_null_is_a_key(spark):
    """An upsert that is repeated gives the same table; deletions by keys reach null keys."""
    schema = "k int, j string, v int"
    dst = spark.createDataFrame([(1, "a", 0), (None, "a", 0), (None, None, 0), (2, None, 0)], schema)
    new = spark.createDataFrame([(None, "a", 1), (2, None, 1), (3, "c", 1)], schema)
    want = sorted([(1, "a", 0), (None, None, 0), (None, "a", 1), (2, None, 1), (3, "c", 1)], key=repr)
    once = upsert(dst, new, ["k", "j"])
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, upsert(once, new, ["k", "j"]).collect()), key=repr) == want
    assert sorted(map(tuple, delete_by_keys(dst, new, ["k", "j"]).collect()), key=repr) == sorted([(1, "a", 0), (None, None, 0)], key=repr)
    assert sorted(map(tuple, delete_insert(dst, new, ["k", "j"]).collect()), key=repr) == want


def test_a_scope_removes_its_folders(spark):
    from pathlib import Path

    outer = folder(spark)
    with scope(spark):
        kept = saved(spark.range(5)).count()
        inner = folder(spark)
        assert Path(inner.removeprefix("file:")).parent.exists()
    assert kept == 5 and not Path(inner.removeprefix("file:")).parent.exists() and Path(outer.removeprefix("file:")).parent.exists()
