"""Changed buckets of several dimensions, hex texts and values as conditions that reach the scan."""

from __future__ import annotations

import itertools

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.test_engine import plan_of
from tidemark.functions.buckets import partition_id
from tidemark.operators import diff as D
from tidemark.spec import Dimension


@given(st.integers(1, 3).flatmap(lambda n: st.lists(st.tuples(*[st.integers(-4, 5)] * n), max_size=60)))
def test_boxes_hold_the_cells_and_no_others(cells):
    found = D.boxes(cells)
    held = [c for box in found for c in itertools.product(*[range(lo, hi + 1) for lo, hi in box])]
    assert len(held) == len(set(held)) and set(held) == set(cells)


def pushed(df) -> str:
    return " ".join(p.split("\n")[0] for p in plan_of(df).split("PushedFilters: [")[1:])


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("boxes") / "t")
    u = F.when(F.col("id") % 2 == 0, F.upper(F.md5(F.col("id").cast("string")))).otherwise(F.md5(F.col("id").cast("string")))
    rows = spark.range(4000).select("id", (F.col("id") % 97 - 20).alias("k"), F.expr("TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(CAST(id % 300 AS INT), 5)").alias("t"), u.alias("u"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("c-"), (F.col("id") % 7).cast("string"))).alias("c"))
    rows.coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def changed(df, dims, ids):
    return df.sparkSession.createDataFrame([(i,) for i in ids], "_bucket string")


@pytest.mark.parametrize(
    ("dims", "ids", "words"),
    [
        ([Dimension("k", 10), Dimension("t", 1, "datetime", "month")], ["-2-648", "-1-648", "-2-649", "-1-649", "5-652"], ["k", "t"]),
        ([Dimension("k", 10), Dimension("id", 100), Dimension("t", 10, "date", "day")], ["0-3-1973", "1-3-1973"], ["k", "id", "t"]),
        ([Dimension("u", 1 << 24, "hex")], ["16", "17", "18", "255"], ["StringStartsWith(u,1)", "StringStartsWith(u,f)", "StringStartsWith(u,F)"]),
        ([Dimension("k", 10), Dimension("u", 1 << 28, "hex")], ["0-3", "0-4"], ["k", "StringStartsWith(u,3)"]),
        ([Dimension("c", kind="value")], ["c-2", "c-5", ""], ["c-2,c-5])"]),
        ([Dimension("k", kind="value")], ["-3", "12"], ["In(k, [-3,12])"]),
        ([Dimension("k", 1)], [str(i) for i in range(-20, 77, 2)], ["k"]),
        ([Dimension("k", 10)], [], []),
    ],
)
def test_conditions_reach_the_scan_and_lose_nothing(table, dims, ids, words):
    wanted = changed(table, dims, ids)
    got = D.within_buckets(table, dims, wanted)
    plain = table.withColumn("_b", partition_id(dims)).where(F.col("_b").isin(ids)) if ids else table.limit(0)
    assert sorted(r.id for r in got.select("id").collect()) == sorted(r.id for r in plain.select("id").collect())
    found = pushed(got)
    assert all(w in found for w in words), found
    assert not ids or len(got.take(1)) == 1


def test_beyond_the_listed(table, monkeypatch):
    """Many buckets are bounded in each dimension; a semi-join tells the rest."""
    dims, ids = [Dimension("k", 1), Dimension("id", 100)], [f"{k}-{i}" for k in range(0, 40, 2) for i in range(0, 20, 3)]
    want = sorted(r.id for r in table.withColumn("_b", partition_id(dims)).where(F.col("_b").isin(ids)).collect())
    for listed, ranges in ((10_000, 100), (50, 100), (10_000, 1000)):
        monkeypatch.setattr(D, "LISTED", listed)
        monkeypatch.setattr(D, "RANGES", ranges)
        got = D.within_buckets(table, dims, changed(table, dims, ids))
        assert sorted(r.id for r in got.select("id").collect()) == want and "k" in pushed(got)
    # an id of a null value is no pair of numbers
    nulls = table.withColumn("k", F.when(F.col("id") != 7, F.col("k")))
    assert [r.id for r in D.within_buckets(nulls, dims, changed(table, dims, ["0"])).collect()] == [7]
