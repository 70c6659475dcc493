"""Worked examples, invariants, idempotence and plans."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import buckets as B
from tidemark.functions import hashing as H
from tidemark.functions.casting import cast
from tidemark.operators import diff as D
from tidemark.operators import grids as G
from tidemark.operators import joins as J
from tidemark.operators import predicates as P
from tidemark.operators.aggregate import affected_ranges, affected_values, grouped
from tidemark.operators.dedup import keep_last
from tidemark.operators.schema import drift, evolve
from tidemark.plans import strategies as S
from tidemark.queries.registry import HASHED, dst, src
from tidemark.sources.writers import apply_changes, upsert
from tidemark.spec import UNITS, ColumnSpec, Dimension, TableSpec

KEYS = {"user_id": "user_id", "order_date": "CAST(order_date AS DATE)"}
AGGREGATES = {"num_orders": "count(*)", "total": "sum(amount)", "last_updated_at": "max(updated_at)"}


def orders(spark, second: tuple):
    rows = [(1, 101, 50, "2024-01-15", "2024-01-15 10:00:00"), (2, 101, *second), (3, 102, 75, "2024-01-15", "2024-01-15 12:00:00")]
    return spark.createDataFrame(rows, "order_id int, user_id int, amount int, order_date string, updated_at string")


def test_aggregate_example(spark):
    """An order of one user changes: its group alone is aggregated again, over all its rows."""
    before = grouped(orders(spark, (30, "2024-01-15", "2024-01-15 11:00:00")), KEYS, AGGREGATES)
    changed = orders(spark, (40, "2024-01-15", "2024-01-15 14:00:00"))
    fresh = S.aggregate_delta(changed, before, "updated_at", "last_updated_at", KEYS, AGGREGATES)
    after = {r.user_id: (r.num_orders, r.total, r.last_updated_at[11:16]) for r in upsert(before, fresh, ["user_id", "order_date"]).collect()}
    assert after == {101: (2, 90, "14:00"), 102: (1, 75, "12:00")}
    # the other user's order is at the watermark and is read again, which changes nothing
    assert {r.user_id for r in fresh.collect()} == {101, 102}


def test_diff_and_apply_are_idempotent(spark, sf_dir):
    s, t = src(spark, sf_dir), dst(spark, sf_dir)
    after = apply_changes(t, D.hash_changes(s, t, [Dimension("id", 100)], ["id"], HASHED), ["id"])
    assert after.exceptAll(s).isEmpty() and s.exceptAll(after).isEmpty()
    assert D.hash_changes(s, after, [Dimension("id", 100)], ["id"], HASHED).isEmpty()


def test_all_statuses_occur(spark, sf_dir):
    s, t = (D.bucket_hashes(x, [Dimension("id", 100)], HASHED) for x in (src(spark, sf_dir), dst(spark, sf_dir)))
    found = D.bucket_diff(s, t).collect()
    assert {r.status for r in found} == {"A", "M", "D", "N"}
    assert {(r.count_diff > 0) - (r.count_diff < 0) for r in found if r.status == "M"} == {-1, 0, 1}


def test_two_phase_diff_has_no_python_and_no_cartesian(spark, sf_dir):
    plan = D.hash_changes(src(spark, sf_dir), dst(spark, sf_dir), [Dimension("id", 100)], ["id"], HASHED)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_bounds_reach_the_scan(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").where(P.half_open("o_orderkey", 10, 20)).select("o_orderkey")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,10)" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan


@settings(max_examples=8, deadline=None)
@given(lo=st.integers(-5000, 5000), width=st.integers(1, 3000), step=st.integers(1, 700), bounded=st.booleans())
def test_int_grid_is_contiguous(spark, lo, width, step, bounded):
    limits = spark.range(1).select(F.lit(lo).alias("lo"), F.lit(lo + width).alias("hi"))
    cells = sorted((r.start_, r.end_, r.partition_id) for r in G.int_grid(limits, step, bounded).collect())
    assert all(a[1] == b[0] for a, b in zip(cells, cells[1:], strict=False))
    assert cells[0][0] <= lo and cells[-1][1] >= lo + width
    if bounded:
        assert (cells[0][0], cells[-1][1], cells[0][2]) == (lo, lo + width, 0)
    else:
        assert all(c[0] == c[2] * step and c[1] - c[0] == step for c in cells)


@pytest.mark.parametrize("unit", UNITS)
@pytest.mark.parametrize("step", [1, 5])
def test_datetime_grid_and_inverse(spark, unit, step):
    seconds = {"second": 90, "minute": 5000, "hour": 200_000}.get(unit, 90_000_000)
    a = dt.datetime(1968, 2, 29, 13, 7, 11)
    b = a + dt.timedelta(seconds=seconds)
    limits = spark.range(1).select(F.lit(a).cast("timestamp_ntz").alias("lo"), F.lit(b).cast("timestamp_ntz").alias("hi"))
    for bounded in (False, True):
        cells = sorted((r.start_, r.end_) for r in G.datetime_grid(limits, step, unit, bounded).collect())
        assert all(x[1] == y[0] for x, y in zip(cells, cells[1:], strict=False))
        assert cells[0][0] <= a and cells[-1][1] >= b
        assert not bounded or (cells[0][0], cells[-1][1]) == (a, b)
    dim = Dimension("lo", step, "datetime", unit)
    start, end = B.boundary(dim)
    r = limits.select(start.alias("s"), end.alias("e"), B.bucket(dim).alias("i")).first()
    assert r.s <= a < r.e
    assert limits.select(B.unit_index(F.lit(r.s).cast("timestamp_ntz"), unit)).first()[0] == r.i * step


def test_affected_ranges_of_a_thousand_rows(spark):
    rows = spark.range(1000).selectExpr("id * 10 AS user_id", "concat('c', id % 5) AS category")
    found = affected_ranges(rows, [Dimension("user_id", 1000)]).crossJoin(affected_values(rows, [Dimension("category", 1, "value")]))
    assert found.count() == 50


def test_tuples_are_exact(spark):
    rows = spark.createDataFrame([(u, p) for u in (1, 2) for p in (10, 20, 30)], "user_id int, product_id int")
    kept = P.in_tuples(rows, ["user_id", "product_id"], [(1, 10), (1, 30), (2, 20)])
    assert {tuple(r) for r in kept.collect()} == {(1, 10), (1, 30), (2, 20)}
    with pytest.raises(ValueError):
        P.in_tuples(rows, ["user_id", "product_id"], [(1,)])
    chunks = affected_values(rows, [Dimension("user_id", 100, "value"), Dimension("product_id", 2, "value")]).groupBy("chunk").count().collect()
    assert sorted(r["count"] for r in chunks) == [2, 2, 2]


def test_hash_separates_and_marks_nulls(spark):
    rows = spark.createDataFrame([("1", "23"), ("12", "3"), (None, "a"), ("", "a")], "a string, b string")
    assert rows.select(H.row_hash(["a", "b"])).distinct().count() == 4
    assert rows.select(H.row_hash(["a", "b"], compatible=True)).distinct().count() == 2
    with pytest.raises(ValueError):
        H.group_hash("a", "md5")


def test_row_diff_refuses_repeated_keys(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "id int, x string")
    with pytest.raises(ValueError):
        D.row_diff(twice, twice, ["id"], ["x"], check=True)


def test_clashing_names(spark):
    s = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, status string, count_diff int")
    t = spark.createDataFrame([(1, "x", 1)], "id int, status string, count_diff int")
    for refresh in (False, True):
        got = {(r.id, r.change_type) for r in D.hash_changes(s, t, [Dimension("id", 1)], ["id"], ["status"], refresh).collect()}
        assert got == {(1, "M"), (2, "A")}


def test_empty_sides(spark):
    s = spark.createDataFrame([(1, "a")], "id int, x string")
    none = s.where("id < 0")
    assert [r.change_type for r in D.hash_changes(s, none, [Dimension("id", 1)], ["id"], ["x"]).collect()] == ["A"]
    assert [r.change_type for r in D.hash_changes(none, s, [Dimension("id", 1)], ["id"], ["x"]).collect()] == ["D"]
    assert D.hash_changes(none, none, [Dimension("id", 1)], ["id"], ["x"]).isEmpty()


def test_asof_ties(spark):
    left = spark.createDataFrame([(1, 1, 10)], "id int, k int, t int")
    dim = spark.createDataFrame([(1, 10, 5), (1, 10, 7), (1, 4, 9), (1, 12, 3)], "k int, f int, v int")
    got = {op: J.asof(left, dim, ["k"], "t", "f", op, {"v": "v"}, "v").first().v for op in ("<=", "<", ">=", ">")}
    assert got == {"<=": 7, "<": 9, ">=": 5, ">": 3}


def test_lookup_keeps_own_columns(spark):
    left = spark.createDataFrame([(1, "own")], "id int, name string")
    dim = spark.createDataFrame([(1, "other", 5)], "key int, name string, more int")
    assert J.lookup(left, dim, {"id": "key"}, order=[F.col("more")]).first().asDict() == {"id": 1, "name": "own", "more": 5}


def test_dedup_takes_null_keys(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k int, t int")
    assert {tuple(r) for r in keep_last(rows, ["k"], ["t"]).collect()} == {(None, 2), (1, 3)}


def test_drift(spark):
    have = spark.createDataFrame([], "a int, b decimal(10,2), gone string").schema
    want = spark.createDataFrame([], "a bigint, b decimal(12,2), c date").schema
    assert drift(have, want) == {"add": ["c"], "change": ["a"]}
    with pytest.raises(ValueError):
        evolve(spark.createDataFrame([], "a bigint"), spark.createDataFrame([], "a int").schema)


def test_casts_never_raise(spark):
    bad = spark.createDataFrame([("",), ("x" * 50,), ("9" * 60,), (None,)], "x string")
    kinds = ["integer", "bigint", "smallint", "float", "decimal", "date", "time", "timestamp", "datetime", "boolean", "uuid"]
    rows = bad.select(*[cast("x", k).alias(k) for k in kinds]).collect()
    assert all(r.integer is None and r.date is None and r.uuid is None for r in rows)


def test_spec(spark):
    spec = TableSpec((ColumnSpec("b"), ColumnSpec("a", key=True, order="desc"), ColumnSpec("v", "a + 1", virtual=True), ColumnSpec("c", hashed=False)), ("a > 1",))
    rows = spec.fetch(spark.createDataFrame([(1, 1, 1), (2, 2, 2)], "a int, b int, c int"))
    assert (rows.columns, rows.count(), spec.hashed, spec.keys) == (["b", "a", "c"], 1, ["a", "b"], ["a"])
    with pytest.raises(ValueError):
        Dimension("x", 0)


def test_user_bounds_are_checked(spark):
    rows = spark.range(10)
    assert P.user_bounds(rows, [{"column": "id", "start": 2, "end": 5}]).count() == 3
    with pytest.raises(ValueError):
        P.user_bounds(rows, [{"column": "id", "start": 2, "value": [1]}])


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_watermarks_reach_the_scan(spark, sf_dir):
    s = src(spark, sf_dir)
    old = dst(spark, sf_dir).where("updated_at < TIMESTAMP_NTZ'1997-01-01'")
    for changes in (S.delta(s, old, "updated_at"), S.delta_changed(s, old, "updated_at", ["id"], HASHED)):
        plan = plan_of(changes)
        assert "GreaterThanOrEqual(o_orderdate,1996-12" in plan and "NestedLoop" not in plan
    assert S.delta(s, old.where("id < 0"), "updated_at").count() == s.count()
    for kind, value in (("timestamp", "2024-10-27 02:30:00"), ("date", "2024-01-31"), ("decimal(10,2)", "12.50"), ("string", "b'c"), ("double", "0.1")):
        rows = spark.sql(f"SELECT CAST(\"{value}\" AS {kind}) AS w UNION ALL SELECT NULL")
        assert S.delta(rows, rows, "w").count() == 1


def test_dimensions_are_read_up_to_the_last_event(spark, tmp_path):
    spark.range(100).selectExpr("id % 3 AS k", "id AS f", "id AS v").write.parquet(f"{tmp_path}/dim")
    left = spark.createDataFrame([(1, 0, 40), (2, 1, 50), (3, 9, 45)], "id int, k int, t int")
    found = J.asof_pruned(left, spark.read.parquet(f"{tmp_path}/dim"), ["k"], "t", "f", {"v": "v"}, "v")
    assert "LessThanOrEqual(f,50)" in plan_of(found) and "NestedLoop" not in plan_of(found)
    assert {(r.id, r.v) for r in found.collect()} == {(1, 39), (2, 49), (3, None)}
    assert {r.v for r in J.asof_pruned(left.where("id < 0"), left.select("k", "t", F.col("id").alias("v")), ["k"], "t", "t").collect()} == set()


def test_changed_buckets_reach_the_scan(spark, tmp_path):
    """Rows of a few changed buckets are read by ranges of the key, of many or of others by a semi-join."""
    s = spark.range(0, 20_000).selectExpr("id", "id % 7 AS x", "timestamp_seconds(id * 3600)::timestamp_ntz AS t")
    d = s.where("id NOT IN (5, 105, 7000)").withColumn("x", F.expr("if(id = 12345, -1, x)"))
    for name, rows in (("s", s), ("d", d)):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    s, d = (spark.read.parquet(f"{tmp_path}/{n}") for n in "sd")
    want = {(5, "A"), (105, "A"), (7000, "A"), (12345, "M")}
    for dim in (Dimension("id", 100), Dimension("t", 4, "datetime", "day"), Dimension("t", 1, "datetime", "month")):
        changes = D.hash_changes(s, d, [dim], ["id"], ["id", "x"])
        assert {(r.id, r.change_type) for r in changes.collect()} == want
        plan = plan_of(changes)
        assert f"GreaterThanOrEqual({dim.column}," in plan and "LeftSemi" not in plan
    # the parts of the table that the first phase shows to be unchanged are not read
    changes = D.hash_changes(s, d, [Dimension("id", 100)], ["id"], ["id", "x"])
    assert s.where("id >= 0 AND id < 200 OR id >= 7000 AND id < 7100 OR id >= 12300 AND id < 12400").count() == 400
    spread = d.withColumn("x", F.expr("if(id % 200 = 0, -1, x)"))
    many = D.hash_changes(s, spread, [Dimension("id", 10)], ["id"], ["id", "x"])
    assert "LeftSemi" in plan_of(many) and many.count() == 103
    for dims in ([Dimension("id", 100), Dimension("x", 2)], [Dimension("x", kind="value")]):
        assert {(r.id, r.change_type) for r in D.hash_changes(s, d, dims, ["id"], ["id", "x"]).collect()} == want
    nulls = s.withColumn("id", F.expr("if(id = 3, NULL, id)"))
    assert D.hash_changes(nulls, d, [Dimension("id", 100)], ["id"], ["id", "x"]).where("id IS NULL").count() == 1


def test_changes_are_computed_once(spark, sf_dir):
    s, t = src(spark, sf_dir), dst(spark, sf_dir)
    after = apply_changes(t, D.row_diff(s, t, ["id"], HASHED), ["id"])
    assert "FullOuter" not in plan_of(after)
    assert after.exceptAll(s).isEmpty() and s.exceptAll(after).isEmpty()


def test_rows_are_compared_themselves(spark):
    """Not by a hash, nor are nulls and texts alike."""
    s = spark.createDataFrame([(1, None, 1.0), (2, "\\N", 2.0), (3, "c", float("nan"))], "id int, x string, y double")
    d = spark.createDataFrame([(1, "\\N", 1.0), (2, "\\N", 2.0), (3, "c", float("nan"))], "id int, x string, y double")
    assert [(r.id, r.change_type) for r in D.row_diff(s, d, ["id"], ["x", "y"]).collect()] == [(1, "M")]


def test_sums_of_hashes_do_not_overflow(spark):
    rows = spark.range(32).withColumn("h", F.lit((1 << 60) - 1))
    assert rows.agg(H.block_hash("h")).first()[0] == 32 * ((1 << 60) - 1) % (1 << 63)
    assert rows.where("id < 0").agg(H.block_hash("h")).first()[0] is None


def dimension_rows(n: int, seed: int):
    import random

    rng = random.Random(seed)
    left = [(i, 0 if rng.random() < 0.9 else rng.randrange(3), rng.choice([None, *range(200)])) for i in range(n)]
    dim = [(0 if rng.random() < 0.9 else rng.randrange(4), a := rng.randrange(200), rng.choice([None, a, a - 1, a + rng.randrange(1, 60)]), i) for i in range(n // 2)]
    return left, dim


def test_slices_of_a_hot_key(spark):
    """Nine rows of ten have one key; sliced by time, no window holds more than a slice of it."""
    left, dim = dimension_rows(600, 1)
    rows, facts = spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(dim, "k int, f int, u int, v int")
    for op in ("<=", "<", ">=", ">"):
        whole, sliced = ({(r.id, r.v) for r in J.asof(rows, facts, ["k"], "t", "f", op, {"v": "v"}, "v", slices=n).collect()} for n in (None, 10))
        assert whole == sliced and len(whole) == 600
    cut = rows.withColumn("s", J._slice_of(F.col("t"), 10)).groupBy("k", "s").count().agg(F.max("count")).first()[0]
    assert cut < 600 / 8
    plan = plan_of(J.asof(rows, facts, ["k"], "t", "f", "<=", {"v": "v"}, "v", slices=10))
    assert "hashpartitioning(_k0#" in plan and "_slice#" in plan


@pytest.mark.parametrize("op", ["<=", ">=", ">"])
@pytest.mark.parametrize("open_ended", [True, False])
def test_overlapping_validity(spark, op, open_ended):
    left, dim = dimension_rows(300, 2)
    rows, facts = spark.createDataFrame(left, "id int, k int, t int").repartition(3), spark.createDataFrame(dim, "k int, f int, u int, v int")
    found = J.scd(rows, facts, ["k"], "t", "f", "u", op, open_ended, True, {"v": "v"}, "v")
    assert found.columns == ["id", "k", "t", "v"] and "Cartesian" not in plan_of(found) and "NestedLoop" not in plan_of(found)
    got = {r.id: r.v for r in found.collect()}
    starts = {"<=": lambda f, t: f <= t, ">=": lambda f, t: f >= t, ">": lambda f, t: f > t}[op]
    for i, k, t in left:
        fits = [(f, v) for key, f, u, v in dim if t is not None and key == k and starts(f, t) and (open_ended if u is None else t < u)]
        assert got[i] == (max(fits)[1] if fits else None), (i, k, t)


def odd_rows(n: int, seed: int):
    """Rows of both sides with null keys, null times and null or empty intervals, nine of ten under one key."""
    import random

    rng = random.Random(seed)
    key = lambda: rng.choice([None, 0, 0, 0, 0, 0, 0, 0, 0, 1])
    time = lambda: rng.choice([None, *range(60)])
    left = [(i, key(), time()) for i in range(n)]
    return left, [(key(), f := time(), rng.choice([None, f, *([] if f is None else [f - 1, f + 1, f + rng.randrange(1, 9), f + rng.randrange(1, 70)])]), i) for i in range(n)]


@pytest.mark.parametrize("hot", [False, True])
def test_nulls_and_hot_keys_as_in_sql(spark, monkeypatch, hot):
    """All forms of time joins agree with SQL on null keys, null times and overlaps, whether or not hot keys
    are divided, which takes no setting."""
    import duckdb

    if hot:
        monkeypatch.setattr(J, "HOT_ROWS", 60)
    monkeypatch.setattr(J, "COUNTED_BYTES", 0)
    left, dim = odd_rows(500, 11)
    rows = spark.createDataFrame(left, "id int, k int, t int").repartition(3)
    facts = spark.createDataFrame(dim, "k int, f int, u int, v int").repartition(2)
    c = duckdb.connect()
    c.sql("CREATE TABLE l (id int, k int, t int)")
    c.sql("CREATE TABLE d (k int, f int, u int, v int)")
    c.executemany("INSERT INTO l VALUES (?, ?, ?)", left)
    c.executemany("INSERT INTO d VALUES (?, ?, ?, ?)", dim)

    def sql(on: str, ascending: bool = False) -> list:
        way = "ASC" if ascending else "DESC"
        return sorted(c.sql(f"SELECT id, v FROM l LEFT JOIN d ON l.k = d.k AND {on} QUALIFY row_number() OVER (PARTITION BY id ORDER BY f {way}, v {way}) = 1").fetchall(), key=repr)

    def got(df) -> list:
        return sorted(((r.id, r.v) for r in df.collect()), key=repr)

    for op in ("<=", "<", ">=", ">"):
        assert got(J.asof(rows, facts, ["k"], "t", "f", op, {"v": "v"}, "v")) == sql(f"f {op} t", op[0] == ">"), op
        assert got(J.asof(rows, facts, ["k"], "t", "f", op, {"v": "v"}, "v", slices=7)) == sql(f"f {op} t", op[0] == ">"), op
    assert got(J.asof_pruned(rows, facts, ["k"], "t", "f", {"v": "v"}, "v")) == sql("f <= t")
    best = sorted(c.sql("SELECT id, v FROM l ASOF LEFT JOIN (SELECT k, f, max(v) AS v FROM d GROUP BY ALL) x ON l.k = x.k AND l.t >= x.f").fetchall(), key=repr)
    assert best == sql("f <= t")
    for slices in (None, 7):
        for is_open in (True, False):
            until = "(u IS NULL OR t < u)" if is_open else "t < u"
            for op in ("<=", ">=", ">"):
                found = J.scd(rows, facts, ["k"], "t", "f", "u", op, is_open, fetch={"v": "v"}, tie="v", slices=slices)
                assert got(found) == sql(f"f {op} t AND {until}"), (op, is_open, slices)
    with pytest.raises(ValueError, match="overlap"):
        J.scd(rows, facts, ["k"], "t", "f", "u", fetch={"v": "v"}, overlapping=False, check=True)
    apart = facts.where("f % 5 = 0").withColumn("u", F.col("f") + 4).dropDuplicates(["k", "f"])
    same = [got(J.scd(rows, apart, ["k"], "t", "f", "u", fetch={"v": "v"}, overlapping=o, check=not o)) for o in (True, False)]
    assert same[0] == same[1] and sum(v is not None for _, v in same[0]) > 100


def test_a_hot_key_is_many_tasks(spark, monkeypatch):
    """Nine rows of ten have one key: slices are even, and only hot keys are divided."""
    monkeypatch.setattr(J, "HOT_ROWS", 1000)
    monkeypatch.setattr(J, "COUNTED_BYTES", 0)
    rows = spark.range(20_000).selectExpr("id", "IF(id % 10 > 0, 0, id) AS k", "CAST(pow(id, 1.5) AS BIGINT) AS t")
    keyed = [J._keyed(rows, ["k"], "t")] * 2
    by = ["_k0", "_void"]
    parts = J._divided(keyed, by, None)
    sizes = [r["count"] for r in parts[0].unionByName(parts[1]).where("_k0 = 0").groupBy("_slice").count().collect()]
    assert len(sizes) == 37 and max(sizes) < 1300  # 36,002 rows
    assert parts[0].where("_k0 <> 0 AND _slice > 0").isEmpty()
    plan = plan_of(J.asof(rows, rows.selectExpr("k", "t AS f", "id AS v"), ["k"], "t", "f", "<=", {"v": "v"}))
    assert "_slice" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_database_in_parallel_and_back(spark):
    """A real database: read by a grid's cells, changes staged and taken over in one transaction, twice."""
    from tidemark.sources.readers import cell_predicates, read_jdbc
    from tidemark.sources.writers import apply_jdbc, write_jdbc

    options = {"url": "jdbc:derby:memory:engine;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "dbtable": "people"}
    rows = spark.range(0, 500).selectExpr("CAST(id AS INT) AS id", "concat('n', id) AS name", "timestamp_seconds(id * 86400)::timestamp_ntz AS t")
    write_jdbc(rows, options, "overwrite")
    grid = G.int_grid(spark.range(1).selectExpr("0 AS lo", "500 AS hi"), 100)
    predicates = cell_predicates(grid, '"id"', nulls=True)
    assert len(predicates) == 6 and predicates[0] == '"id" >= 0 AND "id" < 100'
    stored = read_jdbc(spark, options, predicates)
    assert stored.rdd.getNumPartitions() == 6
    assert stored.exceptAll(rows).isEmpty() and stored.count() == 500
    wanted = rows.where("id <> 7").withColumn("name", F.expr("if(id = 9, 'changed', name)")).unionByName(rows.where("id = 1").withColumn("id", F.lit(1000)))
    for _ in range(2):
        changes = D.row_diff(wanted, read_jdbc(spark, options, predicates[:-1] + ['"id" >= 500']), ["id"], ["name", "t"])
        apply_jdbc(changes, options, ["id"])
        after = read_jdbc(spark, options)
        assert after.exceptAll(wanted).isEmpty() and wanted.exceptAll(after).isEmpty()
    with pytest.raises(ValueError, match="cells"):
        cell_predicates(G.int_grid(spark.range(1).selectExpr("0 AS lo", "500000 AS hi"), 1), "id")
    days = G.datetime_grid(spark.range(1).selectExpr("TIMESTAMP_NTZ'2024-01-01' AS lo", "TIMESTAMP_NTZ'2024-01-03' AS hi"), 1, "day")
    assert cell_predicates(days, "t")[0] == "t >= TIMESTAMP '2024-01-01 00:00:00.000000' AND t < TIMESTAMP '2024-01-02 00:00:00.000000'"


def test_a_stream_rewrites_the_buckets_it_meets(spark, tmp_path):
    from pathlib import Path

    from tidemark.streaming.upserts import latest, start_upsert

    schema = "k int, t int, x string"
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        start_upsert(stream, target, f"{tmp_path}/check", ["k"], ["t"], buckets=8, grace=0).awaitTermination()
        return {str(f) for f in Path(target).rglob("*.parquet")} if Path(target).exists() else set()

    assert run([]) == set() and latest(spark, target, spark.createDataFrame([], schema).schema).isEmpty()
    first = run([(k, 1, "a") for k in range(40)] + [(None, 1, "n")])
    second = run([(3, 2, "b"), (3, 0, "late"), (4, 0, "late")])
    assert 1 <= len(first - second) <= 2 and len(first & second) >= 6 and len(second) == len(first)
    got = {r.k: r.x for r in latest(spark, target, spark.createDataFrame([], schema).schema).collect()}
    assert got == {None: "n"} | {k: "b" if k == 3 else "a" for k in range(40)}


def test_small_functions(spark):
    from pyspark.errors import UnsupportedOperationException

    from tidemark.operators.dedup import keep_first
    from tidemark.sources.writers import merge_into

    rows = spark.createDataFrame([(1, 2, "a"), (1, 1, "b"), (2, 5, "c")], "k int, t int, x string")
    assert {tuple(r) for r in keep_first(rows, ["k"], [F.col("t")]).collect()} == {(1, 1, "b"), (2, 5, "c")}
    assert P.in_keys(rows, spark.createDataFrame([(1,), (1,)], "k int"), ["k"]).count() == 2
    rows.write.mode("overwrite").saveAsTable("no_merge_here")
    with pytest.raises(UnsupportedOperationException, match="MERGE"):  # the format decides, and Parquet cannot
        merge_into("no_merge_here", rows.withColumn("change_type", F.lit("A")), ["k"])


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from tidemark.work import shared_folder

    for master in ("local-cluster[2,1,1024]", "yarn", "spark://host:7077"):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))


def test_without_the_optional_subpackage():
    """The engine imports nothing of it."""
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1] / "tidemark"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "tidemark.llm" in p.read_text()]
