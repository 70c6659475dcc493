"""Runs over partitions that a ledger drives: claimed, written, then marked, and taken up again where they stopped.

The ledger has the last state of each partition: its hash, attempt, status, run and message. States are written
to a log, a small file for each group and no Spark job, and a versioned table takes in what a long log holds. A run claims a group of partitions that are not completed under their present hash, writes them with a
writer that may be repeated, and marks them. A run that is lost between any two of these steps leaves claims;
they lapse, and the next run does the work again, which changes nothing that was written. Of two runs that
claim a partition at once the first has it: entries of the log are numbered, a number is had by one run, and a run
reads all entries before its own.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.buckets import partition_id
from tidemark.operators.dedup import keep_last
from tidemark.operators.diff import row_diff, within_buckets
from tidemark.sources import versioned
from tidemark.spec import Dimension
from tidemark.work import listed, saved

#: Seconds after which a claim of a run that says nothing more lapses.
LEASE = 3600.0
#: Buckets of a table that goes by partitions.
BUCKETS = 1024
STATES = ("claimed", "failed", "completed")
_STATE = "partition_id string, hash long, attempt int, rank int, first double, status string, run string, message string"
_ORDER = ["attempt", "rank", "first"]
#: Partitions that a run looks for at once, and entries of a log that a table takes in.
AHEAD, FOLD = 10_000, 1000
#: The name of a log among the sources of a table's batches.
_LOG = "log"

_Part = list[tuple[str, int, int]]


def _entry(number: int) -> str:
    return f"log/{number:020d}.json"


@dataclass
class Ledger:
    """The states of partitions at ``path``, as one run sees and writes them."""

    spark: SparkSession
    path: str
    run: str = field(default_factory=lambda: uuid.uuid4().hex)
    lease: float = LEASE
    clock: Callable[[], float] = time.time

    def __post_init__(self) -> None:
        self._store = versioned.Store(self.spark, self.path)
        self._at = self._last()  # the newest entry that this run knows
        self._news: set[str] = set()  # partitions that others have written of since it last looked for open ones

    def _last(self) -> int:
        return max((int(n.removesuffix(".json")) for n in self._store.names("log") if n.endswith(".json")), default=0)

    def _logged(self) -> DataFrame:
        return self.spark.read.schema(_STATE).option("pathGlobFilter", "*.json").json(f"{self._store.base}/log")

    def states(self) -> DataFrame:
        # the log first: entries go when a table that has them is published
        log = self._logged() if self._store.has("log") else None
        table = versioned.read(self.spark, self.path) if versioned.manifest(self.spark, self.path) else None
        found = [rows for rows in (log, table) if rows is not None]
        return keep_last(reduce(DataFrame.unionByName, found), ["partition_id"], _ORDER) if found else self.spark.createDataFrame([], _STATE)

    def _follow(self) -> bool:
        """Reads what others have written; False if some of it has gone already."""
        while self._store.has(_entry(self._at + 1)):
            lines = self._store.read(_entry(self._at + 1)).split("\n")
            self._news |= {json.loads(line)["partition_id"] for line in lines}
            self._at += 1
        # entries go oldest first, so that nothing is missing while the last one known is there
        if self._at and self._store.has(_entry(self._at)):
            return True
        known, self._at = self._at, self._last()
        return known == self._at

    def _put(self, rows: _Part, status: str, message: str | None = None) -> bool:
        """Makes the next entry; False if another run has made it."""
        # of two claims of one attempt the earlier is the last in order, of other states the later
        first = self.clock() * (-1 if status == "claimed" else 1)
        states = [{"partition_id": p, "hash": h, "attempt": a, "rank": STATES.index(status), "first": first, "status": status, "run": self.run, "message": message} for p, h, a in rows]
        done = self._store.create(_entry(self._at + 1), "\n".join(json.dumps(s) for s in states))
        self._at += done
        return done

    def _write(self, rows: _Part, status: str, message: str | None = None) -> None:
        self._follow()
        while not self._put(rows, status, message):
            self._follow()

    def fold(self, entries: int = FOLD, grace: float = versioned.GRACE) -> None:
        """Takes the log into the table when it has so many entries more than the table, and removes those that a table
        older than ``grace`` seconds has. The newest entry stays, so that numbers go on."""
        before, upto = versioned.manifest(self.spark, self.path), self._at
        taken = before.batches.get(_LOG, 0) if before else 0
        if upto < taken + entries:
            return
        if taken and before.written < time.time() - grace:
            for n in sorted(int(n.removesuffix(".json")) for n in self._store.names("log") if n.endswith(".json")):
                if n <= taken and n < upto:
                    self._store.remove(_entry(n))
        versioned.upsert(self._logged(), self.path, ["partition_id"], _ORDER, buckets=1, source=_LOG, batch=upto)

    def open_partitions(self, partitions: DataFrame, attempts: int) -> DataFrame:
        """(partition_id, hash, attempt) of ``partitions`` (partition_id, hash) that are to be done: not completed with
        this hash, not claimed by a run that may be at work, and not tried ``attempts`` times with this hash."""
        s = self.states().select("partition_id", F.col("hash").alias("_hash"), F.col("attempt").alias("_tried"), "status", "run", F.abs("first").alias("_at"))
        known = partitions.select("partition_id", "hash").join(s, "partition_id", "left")
        same = F.coalesce(F.col("hash").eqNullSafe(F.col("_hash")) & F.col("status").isNotNull(), F.lit(False))
        done = same & (F.col("status") == "completed")
        held = (F.col("status") == "claimed") & (F.col("run") != self.run) & (F.col("_at") > self.clock() - self.lease)
        tried = F.when(same, F.col("_tried")).otherwise(0)
        open_ = ~F.coalesce(done, F.lit(False)) & ~F.coalesce(held, F.lit(False)) & (tried < attempts)
        return known.where(open_).select("partition_id", "hash", (F.coalesce("_tried", F.lit(0)) + 1).alias("attempt"))

    def look(self, partitions: DataFrame, attempts: int, most: int = AHEAD) -> _Part:
        """The first ``most`` open partitions. Only these reach the driver."""
        self._follow()
        self._news = set()
        self.fold()
        return [tuple(r) for r in self.open_partitions(partitions, attempts).orderBy("attempt", "partition_id").limit(most).collect()]

    def take(self, found: _Part, group: int) -> _Part:
        """The first ``group`` of partitions that were looked for are this run's now, and leave the list; those that
        another run has written of in the meantime leave it too, and are looked for again."""
        while True:
            if not self._follow():
                found.clear()
            if self._news:
                found[:] = [p for p in found if p[0] not in self._news]
            wanted = found[:group]
            if not wanted or self._put(wanted, "claimed"):
                del found[:group]
                return wanted

    def claim(self, partitions: DataFrame, group: int, attempts: int) -> _Part:
        """Up to ``group`` partitions that are this run's now."""
        while found := self.look(partitions, attempts, group):
            if mine := self.take(found, group):
                return mine
        return []

    def mark(self, partitions: _Part, status: str, message: str | None = None) -> None:
        self._write(partitions, status, message)


def run_partitions(
    partitions: DataFrame, ledger: Ledger, write: Callable[[list[str]], object], group: int = 16, attempts: int = 3, stop_on_error: bool = False, threads: int = 1,
) -> dict[str, int]:
    """Brings all ``partitions`` (partition_id, hash) to completion, ``group`` at a time, and counts what came of
    them. ``write`` gets the ids of a group, and writes them so that a repetition changes nothing. A group that
    fails is marked so with the error, and its partitions are tried again by themselves, up to ``attempts`` times
    in all runs; with ``stop_on_error`` the run ends instead, and the next one goes on. threads: how many of a
    group that go by themselves are written at the same time, if ``write`` may be called from several threads."""
    partitions, counts = saved(partitions.select("partition_id", "hash")), {"completed": 0, "failed": 0}
    with ThreadPoolExecutor(threads) as pool:
        found: _Part = []
        while True:
            claimed = ledger.take(found, group)
            if not claimed:
                found = ledger.look(partitions, attempts)
                if not found:
                    return counts
                continue
            # what failed before goes alone, so that one partition cannot hold up others
            first, alone = [p for p in claimed if p[2] == 1], [[p] for p in claimed if p[2] > 1]
            for part, error in _outcomes(ledger.spark, write, [first, *alone] if first else alone, pool if threads > 1 else None):
                status = "completed" if error is None else "failed"
                ledger.mark(part, status, None if error is None else f"{type(error).__name__}: {error}"[:500])
                counts[status] += len(part)
                if error is not None and stop_on_error:
                    raise error


def _outcomes(spark: SparkSession, write: Callable[[list[str]], object], parts: list[_Part], pool: ThreadPoolExecutor | None) -> Iterator[tuple[_Part, Exception | None]]:
    """Parts as their writes end, with the error of those that failed."""

    def tried(part: _Part) -> Exception | None:
        try:
            write([p for p, _, _ in part])
        except Exception as e:
            return e
        return None

    if pool is None or len(parts) < 2:
        yield from ((part, tried(part)) for part in parts)
        return
    # each thread has its own copy of the properties that jobs start with
    running = {pool.submit(inheritable_thread_target(spark)(tried), part): part for part in parts}
    for ended in as_completed(running):
        yield running[ended], ended.result()


def _number(partition: Column, row: bool) -> Column:
    """A number of a partition by its id: that of its place in a row, which no other of ``BUCKETS`` neighbours shares
    a bucket with, or a hash."""
    return F.coalesce(partition.try_cast("long"), F.lit(0)) if row else F.xxhash64(partition)


def copy_partitions(src: DataFrame, target: str, dims: list[Dimension], keys: list[str], hashed: list[str], buckets: int = 16) -> Callable[[list[str]], int]:
    """A writer for ``run_partitions`` that brings partitions of a versioned table in step with the source. Rows of
    both sides are read by pushed ranges; where nothing differs nothing is written, so it may be repeated. Where keys
    tell the partition, the table's buckets go by partitions, ``BUCKETS`` of them: a write reads and writes its own
    ones, however large the table is, and partitions that the table has not yet are copied in one job. Otherwise they
    go by keys, and ``buckets`` is their number."""
    own = {d.column for d in dims} <= {*keys}
    row = len(dims) == 1 and dims[0].kind != "value"  # partitions are numbered in a row
    by, layout = (_number(partition_id(dims), row), f"partitions by {dims}" + ", in a row" * row) if own else (None, "")
    many = BUCKETS if own else buckets

    def write(ids: list[str]) -> int:
        spark = src.sparkSession
        wanted, met, before = listed(spark, ids, "_bucket"), None, versioned.manifest(spark, target)
        if own:
            met = sorted({str(r[0]) for r in wanted.select(versioned.bucket_number(_number(F.col("_bucket"), row), many)).collect()})
        new, there = within_buckets(src, dims, wanted), before is not None and (met is None or not before.folders.keys().isdisjoint(met))
        old = within_buckets(versioned.read(spark, target, buckets=met).select(*src.columns), dims, wanted) if there else src.limit(0)
        if own and (not there or old.isEmpty() and not new.isEmpty()):  # buckets may hold other partitions
            return versioned.apply_changes(new.withColumn("change_type", F.lit("A")), target, keys, many, by=by, layout=layout, met=met)
        return versioned.apply_changes(saved(row_diff(new, old, keys, hashed)), target, keys, many, by=by, layout=layout)

    return write
