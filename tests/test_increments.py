"""Trees of hashes that are kept, and aggregates that changes keep up to date."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.test_engine import plan_of
from tidemark.operators import diff as D
from tidemark.operators import increments as I
from tidemark.operators import tree as T
from tidemark.plans import strategies as S
from tidemark.sources import versioned
from tidemark.sources.writers import apply_changes
from tidemark.spec import Dimension

LEVELS = [[Dimension("id", 400)], [Dimension("id", 100)], [Dimension("id", 20)]]
SCHEMA = "id long, x string, t long"


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sides(spark):
    dice = random.Random(6)
    src = [(i, f"v{i}", i // 300) for i in range(3000) if not 1200 <= i < 1420]
    dst = [(i, x if dice.random() > 0.003 else "other", t) for i, x, t in src if not 500 <= i < 790] + [(i, "gone", 0) for i in range(5000, 5050)]
    return spark.createDataFrame(src, SCHEMA), spark.createDataFrame(dst, SCHEMA)


@pytest.mark.parametrize("size", [0, 50, 150, 10_000])
def test_a_tree_gives_what_hashing_each_level_gives(spark, size):
    src, dst = sides(spark)
    trees = [T.leaves(x, LEVELS, ["id", "x"], "t") for x in (src, dst)]
    columns = ["partition_id", "status", "num_rows", "count_diff", "level"]
    assert rows_of(T.drill_tree(*trees, 3, size).select(columns)) == rows_of(D.drill(src, dst, LEVELS, ["id", "x"], size).select(columns))
    assert rows_of(T.level(trees[0], 1)) == rows_of(D.bucket_hashes(src, LEVELS[1], ["id", "x"], outer=LEVELS[0]))


def test_one_scan_and_only_new_leaves(spark, tmp_path, monkeypatch):
    src, _ = sides(spark)
    src.coalesce(1).write.parquet(f"{tmp_path}/src")
    table = spark.read.parquet(f"{tmp_path}/src")
    assert plan_of(T.leaves(table, LEVELS, ["x"], "t")).count("Scan parquet") <= 2  # once in the tree of nodes, once in details
    path = f"{tmp_path}/tree"
    T.renew(table, path, LEVELS, ["id", "x"], "t")
    newer = table.withColumns({"x": F.when(F.col("id") == 77, "new").otherwise(F.col("x")), "t": F.when(F.col("id") == 77, 99).otherwise(F.col("t"))})
    newer = newer.unionByName(spark.createDataFrame([(9000, "added", 99)], SCHEMA))
    newer.coalesce(1).write.parquet(f"{tmp_path}/newer")
    newer, read = spark.read.parquet(f"{tmp_path}/newer"), []
    real = T.rows_of_leaves
    monkeypatch.setattr(T, "rows_of_leaves", lambda *a: read.append(real(*a)) or read[-1])
    got = rows_of(T.renew(newer, path, LEVELS, ["id", "x"], "t"))
    assert got == rows_of(T.leaves(newer, LEVELS, ["id", "x"], "t", 15))
    assert "PushedFilters: [Or(" in plan_of(read[0]) or "PushedFilters: [IsNotNull(id), Or(" in plan_of(read[0]) or "GreaterThanOrEqual(id" in plan_of(read[0])
    # the leaf of the changed row, the one of the added row, and those with rows as new as the old watermark
    assert read[0].count() == 20 + 1 + 300
    fewer = newer.where("id >= 100")
    assert rows_of(T.renew(fewer, path, LEVELS, ["id", "x"], "t", rebuild=True)) == rows_of(T.leaves(fewer, LEVELS, ["id", "x"], "t", 15))
    assert versioned.versions(spark, path) == [1, 2, 3]


GROUPS = I.Groups({"k": "k", "day": "CAST(at AS DATE)"}, {"total": I.Measure("sum", "x"), "least": I.Measure("min", "x"), "most": I.Measure("max", "x * 2")}, ("id", "x"), "n")
ROWS = "id int, k int, at timestamp_ntz, x int"


def random_rows(spark, dice, n: int, change: float):
    import datetime as dt

    def row(i: int) -> tuple:
        return i, dice.choice([None, *range(6)]), dt.datetime(2024, 1, 1 + dice.randrange(3), dice.randrange(24)), dice.choice([None, *range(30)])

    old = {i: row(i) for i in range(n)}
    new = {i: (row(i) if dice.random() < change else r) for i, r in old.items() if dice.random() > change / 3} | {i: row(i) for i in range(n, n + n // 20)}
    return spark.createDataFrame([*old.values()], ROWS), spark.createDataFrame([*new.values()], ROWS)


@pytest.mark.parametrize(("seed", "change"), [(1, 0.02), (2, 0.3), (3, 0.9)])
def test_changes_keep_groups_as_their_rows_would(spark, seed, change):
    before, after = random_rows(spark, random.Random(seed), 150, change)
    changes = D.row_diff(after, before, ["id"], ["k", "at", "x"], old=True)
    stored = GROUPS.of(before)
    got = I.merged(stored, changes, after, GROUPS)
    assert {r.change_type for r in got.collect()} >= {"M"}
    held = {(r.k, r.day): tuple(r) for r in stored.collect()}
    for r in got.collect():
        held.pop((r.k, r.day), None)
        if r.change_type != "D":
            held[r.k, r.day] = tuple(r)[:-1]
    # columns of the stored groups and of the changed ones come in the same order
    assert got.columns[:-1] == stored.columns
    assert sorted(held.values(), key=repr) == rows_of(GROUPS.of(after))


def test_only_groups_that_lost_an_extreme_are_read(spark, tmp_path, monkeypatch):
    before = spark.range(4000).selectExpr("CAST(id AS INT) AS id", "CAST(id div 100 AS INT) AS k", "TIMESTAMP_NTZ'2024-01-01' AS at", "CAST(id AS INT) AS x")
    after = before.where("id <> 700").withColumn("x", F.when(F.col("id") == 1234, -5).when(F.col("id") == 2050, 2051).otherwise(F.col("x")))
    after.coalesce(1).write.parquet(f"{tmp_path}/after")
    after, read = spark.read.parquet(f"{tmp_path}/after"), []
    real = I.rows_of_groups
    monkeypatch.setattr(I, "rows_of_groups", lambda *a: read.append(real(*a)) or read[-1])
    changes = D.row_diff(after, before, ["id"], ["k", "x"], old=True)
    got = {r.k: r for r in I.merged(GROUPS.of(before), changes, after, GROUPS).collect()}
    assert {k: (r.n, r.least, r.most) for k, r in got.items()} == {7: (99, 701, 1598), 12: (100, -5, 2598), 20: (100, 2000, 4198)}
    assert read[0].count() == 99  # only the group whose least row is gone
    assert "PushedFilters: [" in plan_of(read[0]) and "k" in plan_of(read[0]).split("PushedFilters: [")[1].split("]")[0]


def test_a_delta_reads_affected_keys_only(spark, tmp_path):
    rows = spark.range(10_000).selectExpr("id", "id div 10 AS user", "id AS t")
    rows.coalesce(1).write.parquet(f"{tmp_path}/rows")
    table = spark.read.parquet(f"{tmp_path}/rows")
    keys, values = {"user": "user"}, {"n": "count(*)", "last": "max(t)"}
    before = S.grouped(table.where("t < 9975"), keys, values)
    found = S.aggregate_delta(table, before, "t", "last", keys, values)
    assert rows_of(found.select("user", "n")) == [(997, 10), (998, 10), (999, 10)]
    pushed = [p.split("]")[0] for p in plan_of(found).split("PushedFilters: [")[1:]]
    assert any("user" in p for p in pushed), pushed


def test_measures_are_checked():
    with pytest.raises(ValueError, match="avg"):
        I.Measure("avg", "x")


def test_signed_groups_apply(spark):
    before, after = random_rows(spark, random.Random(9), 60, 0.5)
    changes = I.merged(GROUPS.of(before), D.row_diff(after, before, ["id"], ["k", "at", "x"], old=True), after, GROUPS)
    known = lambda g: g.where("k IS NOT NULL")
    assert rows_of(apply_changes(known(GROUPS.of(before)), known(changes), ["k", "day"])) == rows_of(known(GROUPS.of(after)))
