"""Versioned tables: failures between any two steps, rival writers, old versions, refusals."""

from __future__ import annotations

import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest

from tidemark.sources import versioned as V
from tidemark.streaming.upserts import latest, start_upsert

SCHEMA = "k int, t int, x string"


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


class Lost(Exception):
    pass


@pytest.mark.parametrize("late", [False, True])
@pytest.mark.parametrize("step", ["_write_files", "_publish", "expire"])
def test_a_batch_that_fails_and_is_repeated(spark, tmp_path, monkeypatch, step, late):
    """The driver is lost before or after each step of a batch. Readers see the version before or the one
    after, and the stream that starts again gives what an unbroken one gives."""
    source, target, check = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    batches = [[(k, 1, "a") for k in range(30)] + [(None, 1, "n")], [(3, 2, "b"), (4, 0, "late"), (None, 2, "m"), (99, 1, "new")], [(3, 3, "c")]]
    wholes, held = [], {}
    for batch in batches:
        for k, t, x in batch:
            if k not in held or t >= held[k][0]:
                held[k] = (t, x)
        wholes.append(sorted(((k, *v) for k, v in held.items()), key=repr))

    def run() -> None:
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        start_upsert(stream, target, check, ["k"], ["t"], buckets=8, grace=0).awaitTermination()

    real = getattr(V, step)

    def failing(*args):
        if late:
            real(*args)
        raise Lost(step)

    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if n == 1:
            monkeypatch.setattr(V, step, failing)
            for _ in range(2):  # it is lost twice
                with pytest.raises(Exception, match="Lost|STREAM_FAILED"):
                    run()
                published = (step == "_publish" and late) or step == "expire"
                assert rows_of(V.read(spark, target)) == wholes[1 if published else 0]
                if published:
                    break
            monkeypatch.setattr(V, step, real)
        run()
        assert rows_of(latest(spark, target, spark.createDataFrame([], SCHEMA).schema)) == wholes[n]
    assert V.manifest(spark, target).batches == {check: 2} and V.versions(spark, target) == [3]
    named = {f for f in V.manifest(spark, target).folders.values()}
    assert {str(p.relative_to(target)) for p in (tmp_path / "out/data").glob("*/b__=*")} == named


def test_two_writers(spark, tmp_path, monkeypatch):
    """A writer that finds its version taken starts again from the other's."""
    target = f"{tmp_path}/t"
    real, calls = V._publish, []

    def publish(store, after):
        if not calls:
            calls.append(1)
            assert V.upsert(spark.createDataFrame([(1, 5, "other"), (2, 1, "other")], SCHEMA), target, ["k"], ["t"], 4) == 1
        return real(store, after)

    monkeypatch.setattr(V, "_publish", publish)
    assert V.upsert(spark.createDataFrame([(1, 4, "mine"), (3, 1, "mine")], SCHEMA), target, ["k"], ["t"], 4) == 2
    assert rows_of(V.read(spark, target)) == [(1, 5, "other"), (2, 1, "other"), (3, 1, "mine")]
    assert rows_of(V.read(spark, target, 1)) == [(1, 5, "other"), (2, 1, "other")]
    assert not list((tmp_path / "t/versions").glob("*.tmp"))


def test_what_is_refused(spark, tmp_path):
    target, rows = f"{tmp_path}/t", spark.createDataFrame([(1, 1, "a")], SCHEMA)
    assert V.manifest(spark, target) is None and V.versions(spark, target) == []
    with pytest.raises(ValueError, match="no version"):
        V.read(spark, target)
    assert V.upsert(rows.limit(0), target, ["k"], ["t"], 4) == 0
    V.upsert(rows, target, ["k"], ["t"], 4)
    for bad, keys, buckets, why in ((rows, ["k"], 8, "4 buckets"), (rows, ["t"], 4, "buckets by"), (rows.drop("x"), ["k"], 4, "missing"), (rows.selectExpr("k", "t", "1 AS x"), ["k"], 4, "x is string")):
        with pytest.raises(ValueError, match=why):
            V.upsert(bad, target, keys, ["t"], buckets)
    assert V.upsert(rows.selectExpr("2 AS k", "t", "x", "7L AS added"), target, ["k"], ["t"], 4) == 2
    assert rows_of(V.read(spark, target)) == [(1, 1, "a", None), (2, 1, "a", 7)]


def test_changes_and_grace(spark, tmp_path):
    target = f"{tmp_path}/t"
    first = [(k, f"v{k}", "A") for k in range(10)] + [(None, "none", "A")]
    assert V.apply_changes(spark.createDataFrame(first, "k int, x string, change_type string"), target, ["k"], 4) == 1
    more = [(1, None, "D"), (2, "w", "M"), (20, "new", "A"), (None, None, "D"), (77, None, "D")]
    changes = spark.createDataFrame(more, "k int, x string, change_type string")
    assert V.apply_changes(changes, target, ["k"], 4, source="run", batch=1) == 2
    assert V.apply_changes(changes, target, ["k"], 4, source="run", batch=1) == 2  # done already
    assert rows_of(V.read(spark, target)) == sorted([(k, f"v{k}") for k in (0, *range(3, 10))] + [(2, "w"), (20, "new")], key=repr)
    assert V.versions(spark, target) == [1, 2] and len(rows_of(V.read(spark, target, 1))) == 11
    time.sleep(0.05)
    V.expire(spark, target, 0)
    assert V.versions(spark, target) == [2] and len(rows_of(V.read(spark, target))) == 10


def test_only_met_buckets_are_read(spark, tmp_path):
    target = f"{tmp_path}/t"
    V.upsert(spark.range(1000).selectExpr("CAST(id AS INT) AS k", "1 AS t", "'a' AS x"), target, ["k"], ["t"], 16)
    old = V.manifest(spark, target).folders
    V.upsert(spark.createDataFrame([(5, 2, "b")], SCHEMA), target, ["k"], ["t"], 16)
    new = V.manifest(spark, target).folders
    assert sum(old[b] != new[b] for b in old) == 1 and V.read(spark, target).count() == 1000


def test_a_writer_of_other_buckets_keeps_its_files(spark, tmp_path, monkeypatch):
    """What a rival published in the meantime stands beside files that are written once."""
    target = f"{tmp_path}/t"
    real, files, calls = V._publish, V._write_files, []
    rows = {k: spark.createDataFrame([(k, 1, "a")], SCHEMA) for k in range(8)}
    at = {k: r.select(V.bucket_number(["k"], 4)).first()[0] for k, r in rows.items()}
    other = next(k for k in at if at[k] != at[0])

    def publish(store, after):
        if len(calls) == 1:
            V.upsert(rows[other], target, ["k"], ["t"], 4)
        return real(store, after)

    monkeypatch.setattr(V, "_publish", publish)
    monkeypatch.setattr(V, "_write_files", lambda *args: calls.append(1) or files(*args))
    assert V.upsert(rows[0], target, ["k"], ["t"], 4) == 2 and len(calls) == 2
    assert rows_of(V.read(spark, target)) == [(0, 1, "a"), (other, 1, "a")]


def test_one_of_many_has_a_place(spark, tmp_path):
    """Of threads that put a file in one place at once exactly one does, and the file is its own."""
    store, meet = V.Store(spark, f"{tmp_path}/t"), threading.Barrier(4)

    def put(name: str, text: str) -> bool:
        meet.wait(60)
        return store.create(name, text)

    with ThreadPoolExecutor(4) as pool:
        for n in range(150):
            won = list(pool.map(put, [f"v/{n}"] * 4, "abcd"))
            assert sum(won) == 1 and store.read(f"v/{n}") == "abcd"[won.index(True)]
    assert sorted(store.names("v")) == sorted(str(n) for n in range(150))
