"""Rows that a database refuses, with a database of the standard library."""

from __future__ import annotations

import sqlite3
from functools import partial

import pytest
from pyspark.sql import functions as F

from tidemark.sources import database as DB
from tidemark.sources.writers import failed_partitions

TABLE = "CREATE TABLE t (id INTEGER PRIMARY KEY, code TEXT NOT NULL CHECK (length(code) <= 5), amount REAL CONSTRAINT positive CHECK (amount > 0), other INTEGER UNIQUE)"


@pytest.fixture
def connect(tmp_path):
    at = partial(sqlite3.connect, f"{tmp_path}/t.db", timeout=120, autocommit=False)
    c = at()
    c.execute(TABLE)
    c.execute("INSERT INTO t VALUES (5, 'there', 1, -1), (15, 'there', 1, -2)")
    c.commit()
    c.close()
    return at


def rows(spark, n=400):
    code = F.when(F.col("id") % 17 == 3, "too long").when(F.col("id") % 23 != 4, "ok")
    return spark.range(n, numPartitions=4).select("id", code.alias("code"), F.when(F.col("id") % 19 == 2, -1.0).otherwise(2.5).alias("amount"), F.when(F.col("id") != 39, F.col("id")).otherwise(38).alias("other"), (F.col("id") % 4).cast("string").alias("partition_id"))


def expected(n=400) -> dict[int, str]:
    """The messages by id; the order of checks is the database's."""
    out = {}
    for i in range(n):
        if i % 17 != 3 and i % 23 == 4:
            out[i] = "NOT NULL constraint failed: t.code"
        elif i % 17 == 3:
            out[i] = "CHECK constraint failed: length(code) <= 5"
        elif i % 19 == 2:
            out[i] = "CHECK constraint failed: positive"
        elif i in (5, 15):
            out[i] = "UNIQUE constraint failed: t.id"
        elif i == 39:
            out[i] = "UNIQUE constraint failed: t.other"
    return out


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_good_rows_are_taken_and_others_come_back(spark, connect, batch):
    df = rows(spark)
    refused = DB.insert_rows(df.drop("partition_id"), connect, "t", batch=batch)
    assert {r.id: r.error__ for r in refused.collect()} == expected()
    c = connect()
    assert [r[0] for r in c.execute("SELECT id FROM t ORDER BY id")] == [i for i in range(400) if i not in expected() or i in (5, 15)]
    c.close()
    assert {r.partition_id for r in failed_partitions(df.join(refused.select("id"), "id")).collect()} == {"0", "1", "2", "3"}


def test_a_repeated_run_inserts_nothing_twice(spark, connect):
    df = rows(spark).drop("partition_id").sortWithinPartitions("id")
    first = DB.insert_rows(df, connect, "t", run="r1")
    again = DB.insert_rows(df, connect, "t", run="r1")
    assert sorted(map(tuple, first.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)
    c = connect()
    assert c.execute("SELECT count(*) FROM t").fetchone()[0] == 400 - len(expected()) + 2
    c.close()
    assert DB.insert_rows(df.limit(0), connect, "t").isEmpty()


def test_a_task_that_is_lost_after_some_batches(spark, connect, monkeypatch, tmp_path):
    """Nothing of its transaction stays, and the repeated call takes all."""

    class Broken:
        def __init__(self, real):
            self.real, self.calls = real, 0

        def cursor(self):
            return self

        def execute(self, *a):
            return self.real.execute(*a)

        def executemany(self, *a):
            self.calls += 1
            if self.calls == 3:
                raise sqlite3.OperationalError("the connection is lost")
            return self.real.executemany(*a)

        def __getattr__(self, name):
            return getattr(self.real, name)

    df = spark.range(100, 200, numPartitions=1).selectExpr("id", "'ok' AS code", "1.5D AS amount", "id AS other")
    with pytest.raises(Exception, match="the connection is lost"):
        DB.insert_rows(df, lambda: Broken(connect()), "t", batch=10, run="r")
    c = connect()
    assert c.execute("SELECT count(*) FROM t").fetchone()[0] == 2
    c.close()
    assert DB.insert_rows(df, connect, "t", batch=10, run="r").isEmpty()
    back = DB.read_rows(spark, connect, [f"SELECT id, code FROM t WHERE id >= {a} AND id < {a + 50}" for a in range(0, 200, 50)], "id bigint, code string")
    assert sorted(r.id for r in back.collect()) == [5, 15, *range(100, 200)] and back.rdd.getNumPartitions() == 4


def test_statements_that_are_wrong_fail(spark, connect):
    with pytest.raises(Exception, match="no column named zzz"):
        DB.insert_rows(spark.range(3).selectExpr("id", "1 AS zzz"), connect, "t")


def test_no_savepoint_stays_open(spark, tmp_path):
    """However many rows are refused, one savepoint for each halving is the most that is open at once."""
    log = f"{tmp_path}/log"

    class Logged:
        def __init__(self, real):
            self.real = real

        def cursor(self):
            return self

        def execute(self, sql, *a):
            with open(log, "a") as f:
                f.write(f"{sql}\n")
            return self.real.execute(sql, *a)

        def __getattr__(self, name):
            return getattr(self.real, name)

    at = partial(sqlite3.connect, f"{tmp_path}/o.db", timeout=120, autocommit=False)
    c = at()
    c.execute(TABLE)
    c.commit()
    c.close()
    df = spark.range(200, numPartitions=1).selectExpr("id", "IF(id % 3 = 0, 'too long', 'ok') AS code", "1.5D AS amount", "id AS other")
    assert DB.insert_rows(df, lambda: Logged(at()), "t").count() == 67
    opened = most = 0
    for line in open(log):
        opened += line.startswith("SAVEPOINT") - line.startswith("RELEASE")
        most = max(most, opened)
    assert opened == 0 and 0 < most <= 8


def test_many_refused_rows_are_tried_one_by_one(spark, tmp_path):
    """Where most rows are refused, batches after the first are not halved from the top: about a statement a row."""
    log = f"{tmp_path}/log"

    class Counted:
        def __init__(self, real):
            self.real = real

        def cursor(self):
            return self

        def executemany(self, sql, rows):
            with open(log, "a") as f:
                f.write(f"{len(rows)}\n")
            return self.real.executemany(sql, rows)

        def __getattr__(self, name):
            return getattr(self.real, name)

    at = partial(sqlite3.connect, f"{tmp_path}/m.db", timeout=120, autocommit=False)
    c = at()
    c.execute(TABLE)
    c.commit()
    c.close()
    df = spark.range(2000, numPartitions=1).selectExpr("id", "IF(id % 5 < 3, 'too long', 'ok') AS code", "1.5D AS amount", "id AS other")
    assert DB.insert_rows(df, lambda: Counted(at()), "t", batch=200).count() == 1200
    assert len(open(log).readlines()) < 2000 + 500
    c = at()
    assert c.execute("SELECT count(*), min(id), max(id) FROM t").fetchone() == (800, 3, 1999)
    c.close()
    # and where none is, in whole batches
    rest = spark.range(3000, 4000, numPartitions=1).selectExpr("id", "'ok' AS code", "1.5D AS amount", "id AS other")
    assert DB.insert_rows(rest, lambda: Counted(at()), "t", batch=200).isEmpty()
    assert [int(x) for x in open(log).readlines()[-5:]] == [200] * 5
