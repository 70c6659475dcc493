"""Runs that a ledger drives: lost runs, failing partitions, rivals, and new hashes."""

from __future__ import annotations

import threading

import pytest

from tidemark.operators.diff import bucket_hashes
from tidemark.plans import resume as R
from tidemark.sources import versioned
from tidemark.spec import Dimension

DIMS = [Dimension("id", 10)]


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def src(spark):
    return spark.range(75).selectExpr("id", "CONCAT('v', id) AS x")


def states(ledger) -> dict[str, tuple]:
    return {r.partition_id: (r.status, r.attempt, r.run) for r in ledger.states().collect()}


@pytest.mark.parametrize("after_write", [False, True])
def test_a_lost_run_is_taken_up(spark, tmp_path, src, after_write):
    target, path = f"{tmp_path}/t", f"{tmp_path}/ledger"
    parts, write, seen = bucket_hashes(src, DIMS, ["id", "x"]), R.copy_partitions(src, target, DIMS, ["id"], ["x"]), []

    def lost(ids):
        seen.append(ids)
        if len(seen) == 2:
            if after_write:
                write(ids)
            raise KeyboardInterrupt  # the driver goes, nothing is marked
        write(ids)

    first = R.Ledger(spark, path, "first")
    with pytest.raises(KeyboardInterrupt):
        R.run_partitions(parts, first, lost, group=3)
    assert sorted(s for s, _, _ in states(first).values()) == ["claimed"] * 3 + ["completed"] * 3
    # the claims hold while the run may be at work
    waiting = R.Ledger(spark, path, "second")
    again = []
    assert R.run_partitions(parts, waiting, lambda ids: again.append(ids) or write(ids), group=3) == {"completed": 2, "failed": 0}
    lapsed = R.Ledger(spark, path, "third", lease=0.0)
    assert R.run_partitions(parts, lapsed, lambda ids: again.append(ids) or write(ids), group=3) == {"completed": 3, "failed": 0}
    assert sorted(i for ids in [seen[0], *again] for i in ids) == [str(i) for i in range(8)]  # each partition is completed once
    assert rows_of(versioned.read(spark, target)) == rows_of(src)
    assert R.run_partitions(parts, lapsed, write) == {"completed": 0, "failed": 0}
    changed = src.where("id <> 14").selectExpr("id", "IF(id = 3, 'new', x) AS x")
    fresh = R.copy_partitions(changed, target, DIMS, ["id"], ["x"])
    assert R.run_partitions(bucket_hashes(changed, DIMS, ["id", "x"]), lapsed, fresh) == {"completed": 2, "failed": 0}
    assert rows_of(versioned.read(spark, target)) == rows_of(changed)


def test_failing_partitions(spark, tmp_path, src):
    """One that always fails is tried as often as allowed and holds up no other."""
    target, ledger = f"{tmp_path}/t", R.Ledger(spark, f"{tmp_path}/ledger", "a")
    parts, write, tried = bucket_hashes(src, DIMS, ["id"]), R.copy_partitions(src, target, DIMS, ["id"], ["x"]), []

    def failing(ids):
        tried.append(ids)
        if "4" in ids:
            raise OSError("no")
        write(ids)

    assert R.run_partitions(parts, ledger, failing, group=8, attempts=3) == {"completed": 7, "failed": 8 + 2}
    assert states(ledger)["4"][:2] == ("failed", 3) and sum("4" in ids for ids in tried) == 3 and tried[1:] and all(len(i) == 1 for i in tried[1:])
    assert ledger.states().where("partition_id = '4'").first().message == "OSError: no"
    with pytest.raises(OSError, match="no"):
        R.run_partitions(parts, ledger, failing, attempts=4, stop_on_error=True)
    assert R.run_partitions(parts, ledger, write, attempts=9) == {"completed": 1, "failed": 0}
    assert rows_of(versioned.read(spark, target)) == rows_of(src)


def test_the_first_of_two_claims_holds(spark, tmp_path, src):
    parts = bucket_hashes(src, DIMS, ["id"]).select("partition_id", "hash")
    early, late = R.Ledger(spark, f"{tmp_path}/l", "early", clock=lambda: 1000.0), R.Ledger(spark, f"{tmp_path}/l", "late", clock=lambda: 1001.0)
    both = [tuple(r) for r in late.open_partitions(parts, 3).orderBy("partition_id").limit(2).collect()]
    assert early.claim(parts, 2, 3) == both
    late._write(both, "claimed")  # it had looked before the other one claimed
    assert {r.run for r in early.states().collect()} == {"early"}
    assert [p for p, _, _ in late.claim(parts, 2, 3)] == ["2", "3"]


def test_a_write_leaves_other_partitions_alone(spark, tmp_path, src):
    """Files of other partitions are neither read nor written again, and a manifest is not looked for in a list of all."""
    target = f"{tmp_path}/t"
    write = R.copy_partitions(src, target, DIMS, ["id"], ["x"])
    write(["0", "1"])
    before = versioned.manifest(spark, target).folders
    write(["2"])
    after = versioned.manifest(spark, target).folders
    assert len(before) == 2 and {b: after[b] for b in before} == before and len(after) == 3
    assert write(["1"]) == 2 and rows_of(versioned.read(spark, target)) == rows_of(src.where("id < 30"))
    with pytest.raises(ValueError, match="go by partitions"):
        versioned.apply_changes(src.selectExpr("*", "'A' AS change_type"), target, ["id"], R.BUCKETS)


def jobs(spark) -> int:
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def test_new_partitions_are_copied_in_one_job(spark, tmp_path, src):
    """Neither an intermediate table nor a look for buckets goes before the write of partitions that a table has not
    yet, also where their bucket has others; a repeated write finds no difference and writes nothing."""
    target, ids = f"{tmp_path}/t", [str(i) for i in range(8)]
    src.write.parquet(f"{tmp_path}/src")
    stored = spark.read.parquet(f"{tmp_path}/src")
    write = R.copy_partitions(stored, target, DIMS, ["id"], ["x"])
    for n, i in enumerate(ids):
        before = jobs(spark)
        assert write([i]) == n + 1 and jobs(spark) - before <= 3  # a shuffle is a job of its own
    assert [write([i]) for i in ids] == [8] * 8 and write(["99"]) == 8 and versioned.versions(spark, target)[-1] == 8
    assert rows_of(versioned.read(spark, target)) == rows_of(stored)


def test_partitions_of_one_bucket(spark, tmp_path, monkeypatch, src):
    monkeypatch.setattr(R, "BUCKETS", 2)
    target = f"{tmp_path}/t"
    write = R.copy_partitions(src, target, DIMS, ["id"], ["x"])
    for n, i in enumerate(("0", "1", "2", "3", "4", "5", "6", "7")):
        assert write([i]) == n + 1
    assert write(["3"]) == 8 and write(["8"]) == 8 and rows_of(versioned.read(spark, target)) == rows_of(src)
    changed = src.where("id <> 14").selectExpr("id", "IF(id = 3, 'new', x) AS x")
    assert R.copy_partitions(changed, target, DIMS, ["id"], ["x"])(["0", "1"]) == 9
    assert rows_of(versioned.read(spark, target)) == rows_of(changed)


@pytest.mark.parametrize("threads", [1, 4])
def test_partitions_that_go_alone_at_the_same_time(spark, tmp_path, src, threads):
    """Each is written and marked by itself, and one that fails fails alone."""
    target, ledger, tried, meet = f"{tmp_path}/t", R.Ledger(spark, f"{tmp_path}/l", "a"), [], threading.Barrier(threads)
    parts, write = bucket_hashes(src, DIMS, ["id", "x"]), R.copy_partitions(src, target, DIMS, ["id"], ["x"])

    def unreliable(ids):
        tried.append(ids)
        if len(ids) > 1:
            raise OSError("not at first")
        if sum(t == ids for t in tried) == 1:
            meet.wait(60)
        if ids == ["2"]:
            raise OSError("no")
        write(ids)

    assert R.run_partitions(parts, ledger, unreliable, group=4, attempts=3, threads=threads) == {"completed": 7, "failed": 8 + 2}
    found = states(ledger)
    assert {i for i, s in found.items() if s[0] == "failed"} == {"2"} and all(s[1] == (3 if i == "2" else 2) for i, s in found.items())
    assert sorted(len(t) for t in tried) == [1] * 9 + [4, 4] and rows_of(versioned.read(spark, target)) == rows_of(src.where("id NOT BETWEEN 20 AND 29"))


def test_the_ledger_is_written_without_jobs(spark, tmp_path, src):
    """Partitions are looked for once, not for each group, and neither claims nor marks start a task."""
    parts, ledger = bucket_hashes(src, DIMS, ["id"]).select("partition_id", "hash"), R.Ledger(spark, f"{tmp_path}/l", "a")
    found = ledger.look(parts, 3)
    assert len(found) == 8
    before = jobs(spark)
    while claimed := ledger.take(found, 3):
        ledger.mark(claimed[:1], "failed", "a 'quoted' \"text\"\nof two lines   é")
        ledger.mark(claimed[1:], "completed")
    assert jobs(spark) == before and found == []
    assert {p: s[:2] for p, s in states(ledger).items()} == {str(i): ("failed" if i % 3 == 0 else "completed", 1) for i in range(8)}
    assert ledger.states().where("partition_id = '3'").first().message == "a 'quoted' \"text\"\nof two lines   é"
    assert [p for p, _, _ in ledger.look(parts, 3)] == ["0", "3", "6"]


def test_what_a_rival_takes_meanwhile(spark, tmp_path, src):
    """Partitions that were looked for and that another run has claimed since are not claimed again."""
    parts = bucket_hashes(src, DIMS, ["id"]).select("partition_id", "hash")
    one, two = R.Ledger(spark, f"{tmp_path}/l", "one"), R.Ledger(spark, f"{tmp_path}/l", "two")
    mine, theirs = one.look(parts, 3), two.look(parts, 3)
    assert mine == theirs and [p for p, _, _ in one.take(mine, 3)] == ["0", "1", "2"]
    put = two._put

    def late(rows, status, message=None):
        two._put = put
        assert [p for p, _, _ in one.take(mine, 2)] == ["3", "4"]  # between two's look at the log and its claim
        return put(rows, status, message)

    two._put = late
    assert [p for p, _, _ in two.take(theirs, 2)] == ["5", "6"] and [p for p, _, _ in one.take(mine, 2)] == ["7"]
    assert two.take(theirs, 2) == [] and [p for p, _, _ in two.look(parts, 3)] == ["5", "6"]  # its own claims
    assert {p: s[2] for p, s in states(one).items()} == {str(i): "two" if i in (5, 6) else "one" for i in range(8)}


def test_a_long_log_goes_into_the_table(spark, tmp_path, src):
    parts, path = bucket_hashes(src, DIMS, ["id"]).select("partition_id", "hash"), f"{tmp_path}/l"
    slow, ledger = R.Ledger(spark, path, "slow"), R.Ledger(spark, path, "a")
    stale = slow.look(parts, 3)
    for status in ("completed", "failed"):
        for claimed in [ledger.claim(parts, 2, 3) for _ in range(2)]:
            ledger.mark(claimed, status)
    whole = rows_of(ledger.states())
    ledger.fold(9)  # not yet
    assert versioned.manifest(spark, path) is None
    for _ in range(2):
        ledger.fold(1, 0.0)
        assert rows_of(ledger.states()) == whole and len(list((tmp_path / "l/log").glob("*.json"))) == 8  # the table is too young to count on, or has all
    ledger.mark([("7", 1, 9)], "failed")
    ledger.fold(1, 0.0)
    assert [int(p.name[:20]) for p in sorted((tmp_path / "l/log").glob("*.json"))] == [9]
    assert [r for r in rows_of(ledger.states()) if r[0] != "7"] == [r for r in whole if r[0] != "7"] and len(whole) == 8
    # one that knows only what has gone looks anew, and numbers go on
    assert slow.take(stale, 2) == [] and [p for p, _, _ in slow.claim(parts, 9, 3)] == ["4", "5", "6", "7"]  # 7 has another hash
    slow.mark([("4", 1, 9)], "completed")
    assert versioned.Store(spark, path).has(R._entry(11)) and states(ledger)["4"] == ("completed", 9, "slow")


def test_neighbours_have_buckets_of_their_own(spark, tmp_path):
    """As many partitions in a row as there are buckets share none; rows without a key are a partition too."""
    src, target = spark.range(-100, R.BUCKETS - 101).selectExpr("IF(id = 5, NULL, id) AS id", "CONCAT('v', id) AS x"), f"{tmp_path}/t"
    write = R.copy_partitions(src, target, [Dimension("id", 1)], ["id"], ["x"])
    assert write(["", *(str(i) for i in range(-100, R.BUCKETS - 101) if i != 5)]) == 1
    found = versioned.manifest(spark, target).folders
    assert len(found) == R.BUCKETS - 2 and write(["7", "-100"]) == 1  # the one without a key is with 0
    assert rows_of(versioned.read(spark, target)) == rows_of(src)
    many = spark.range(40).selectExpr("id", "id % 3 AS kind")
    for dims in ([Dimension("id", 10), Dimension("kind", kind="value")], [Dimension("kind", kind="value")]):
        write = R.copy_partitions(many, target := f"{tmp_path}/{len(dims)}", dims, ["id", "kind"], ["id"])
        ids = [r[0] for r in bucket_hashes(many, dims, ["id"]).collect()]
        assert write(ids[:1]) == 1 and write(ids) == 2 and write(ids) == 2 and rows_of(versioned.read(spark, target)) == rows_of(many)
