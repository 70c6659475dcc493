"""Tables of Parquet files with versions: every write is seen whole or not at all.

A table is a folder. ``data`` holds the files of each write in a folder of its own, one folder per bucket of
keys. ``versions`` holds a manifest per version, which names the folder of every bucket; it is written
beside its place and put there by one rename that fails if the place is taken. Readers follow the newest
manifest. A writer that is lost at any point leaves at worst files that no manifest names, and two writers
of one version cannot both win: the later one goes on from the other's version, and writes its files again where
the other one wrote to its buckets. Manifests and files that
are not of the newest version go when they are older than a grace time, in which readers finish.

A manifest is as long as the number of buckets, which is fixed when a table is made.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tidemark.operators.dedup import keep_last

#: The column of bucket numbers in the files.
BUCKET = "bucket__"
_FOLDER = "b__"
#: Seconds in which a version that has been replaced, or files that have not been published, stay.
GRACE = 3600.0


@dataclass(frozen=True)
class Manifest:
    """version; schema (JSON), keys and number of buckets of the table; the folder of each bucket that has rows,
    below the table's; the last batch of each source of batches; the time of writing; what buckets go by, if not the keys."""

    version: int
    schema: str
    keys: list[str]
    buckets: int
    folders: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    written: float = 0.0
    layout: str = ""

    @property
    def struct(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


class Store:
    """The few operations on files that a table needs, on whatever file system its path is of."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.base, self._new = path.rstrip("/"), self.jvm.org.apache.hadoop.fs.Path
        top = self._path("")
        self.fs = top.getFileSystem(conf)
        self.local = (lambda name: self._path(name).toUri().getPath()) if self.fs.getUri().getScheme() == "file" else None
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def _path(self, name: str) -> object:
        return self._new(f"{self.base}/{name}" if name else self.base)

    def names(self, folder: str) -> dict[str, float]:
        """Names in a folder, with the seconds of their last change; none if there is no folder."""
        path = self._path(folder)
        if not self.fs.exists(path):
            return {}
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self.fs.listStatus(path)}

    def has(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Puts a file with this text in place by one rename; False if the place is taken. A local file system would
        replace what is there: a link is made instead, which fails."""
        beside = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self._path(beside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.local:
            try:
                os.link(self.local(beside), self.local(name))
            except FileExistsError:
                return False
            finally:
                self.remove(beside)
            return True
        try:
            self.context.rename(self._path(beside), self._path(name), self._no_options)
        except Py4JJavaError as e:
            self.remove(beside)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that can be read, oldest first."""
    return _versions(Store(spark, path))


def _versions(store: Store) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in store.names("versions") if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """A version's manifest, the newest one's by default; None if there is no version yet."""
    return _manifest(Store(spark, path), version)


def _manifest(store: Store, version: int | None = None) -> Manifest | None:
    if version is None:
        version = _newest(store)
        if version is None:
            return None
    return Manifest(**json.loads(store.read(_name(version))))


#: The newest version that this process has seen of a table.
_SEEN: dict[str, int] = {}


def _newest(store: Store) -> int | None:
    """The newest version. Versions come one by one and go oldest first, so it is looked for upwards from the one
    seen last, without a list of all, while that one is there."""
    at = _SEEN.get(store.base)
    if at is not None and store.has(_name(at)):
        while store.has(_name(at + 1)):
            at += 1
    if at is None or not store.has(_name(at)):
        at = max(_versions(store), default=None)
    if at is not None:
        _SEEN[store.base] = at
    return at


def _name(version: int) -> str:
    return f"versions/{version:020d}.json"


def read(spark: SparkSession, path: str, version: int | None = None, buckets: list[str] | None = None) -> DataFrame:
    """The rows of a version, the newest by default, or of some buckets of it. Raises ValueError if there is none."""
    found = manifest(spark, path, version)
    if found is None:
        raise ValueError(f"{path} has no version")
    return _rows(spark, path, found, found.folders if buckets is None else buckets).drop(BUCKET)


def _rows(spark: SparkSession, path: str, of: Manifest, buckets: list[str] | dict[str, str]) -> DataFrame:
    """The rows of some buckets, with their number."""
    stored = StructType([*of.struct]).add(BUCKET, IntegerType())
    folders = [f"{path.rstrip('/')}/{of.folders[b]}" for b in buckets if b in of.folders]
    # what holds no rows is known to the planner, so that joins with it fall away
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in stored]
    return spark.read.schema(stored).parquet(*folders) if folders else spark.range(1).limit(0).select(*none)


def _agreed(before: Manifest | None, schema: StructType, keys: list[str], buckets: int, layout: str = "") -> Manifest:
    """The manifest that a write starts from. New columns are taken in; another type of a column, other keys and
    another number of buckets are refused, as rows of a key would be in two buckets."""
    if before is None:
        return Manifest(0, schema.json(), keys, buckets, layout=layout)
    if (before.keys, before.buckets) != (keys, buckets):
        raise ValueError(f"the table has {before.buckets} buckets by {before.keys}, not {buckets} by {keys}")
    if before.layout != layout:
        raise ValueError(f"the buckets of the table go by {before.layout or 'its keys'}, not by {layout or 'its keys'}")
    have = {f.name: f for f in before.struct}
    for f in schema:
        if f.name in have and have[f.name].dataType != f.dataType:
            raise ValueError(f"{f.name} is {have[f.name].dataType.simpleString()} in the table, not {f.dataType.simpleString()}")
    if missing := have.keys() - {f.name for f in schema}:
        raise ValueError(f"columns of the table are missing: {sorted(missing)}")
    return replace(before, schema=StructType([*before.struct, *(f for f in schema if f.name not in have)]).json())


def write_buckets(
    rows: DataFrame, path: str, keys: list[str], buckets: int, combine: Callable[[DataFrame, DataFrame], DataFrame],
    schema: StructType | None = None, source: str | None = None, batch: int | None = None, grace: float = GRACE,
    by: Column | None = None, layout: str = "", met: list[str] | None = None,
) -> int:
    """Rewrites the buckets that ``rows`` meet and returns the version that has them. ``combine`` gets the old
    rows of these buckets and the new ones and gives what the buckets hold from now on, under ``schema``
    (that of ``rows`` by default). At most ``buckets`` numbers reach the driver.

    A batch of a source that a version has already is not written again: a batch that is repeated after a
    failure, wherever it failed, changes nothing.

    by: a number that buckets go by, instead of the keys, and that tells rows of equal keys no different; ``layout``
    names it.
    met: the buckets that rows may be in, where the caller knows them; ``rows`` are then computed only once.
    """
    spark, schema = rows.sparkSession, schema or rows.schema
    store = Store(spark, path)
    numbered = rows.withColumn(BUCKET, bucket_number(by, buckets) if by is not None else bucket_number(keys, buckets))
    base = None  # the version that files have been written for
    while True:
        before = _manifest(store)
        start = _agreed(before, schema, keys, buckets, layout)
        if source is not None and before is not None and before.batches.get(source, -1) >= batch:
            return before.version
        if met is None:
            one = buckets == 1 and not rows.isEmpty()
            met = ["0"] if one else [str(r[0]) for r in numbered.select(BUCKET).distinct().collect()]
        if not met:
            return start.version
        if base is None or base.schema != start.schema or any(base.folders.get(b) != start.folders.get(b) for b in met):
            base, folder = start, f"data/{uuid.uuid4().hex}"
            kept = combine(_rows(spark, path, start, met), numbered)
            _write_files(kept.select(*start.struct.names, BUCKET), f"{store.base}/{folder}")
            full = {n.partition("=")[2] for n in store.names(folder) if n.startswith(f"{_FOLDER}=")}
        folders = {b: f for b, f in start.folders.items() if b not in met} | {b: f"{folder}/{_FOLDER}={b}" for b in full}
        if source is None and folders == start.folders:  # no rows, before or after
            return start.version
        batches = start.batches | ({source: batch} if source is not None else {})
        after = replace(start, version=start.version + 1, folders=folders, batches=batches, written=time.time())
        if _publish(store, after):
            # looked for now and then: all that a table has is listed for it
            if time.monotonic() - _EXPIRED.get(path, -grace) >= grace / 60:
                expire(spark, path, grace)
                _EXPIRED[path] = time.monotonic()
            return after.version


#: When this process last looked for what of a table is out of date.
_EXPIRED: dict[str, float] = {}


def bucket_number(by: Column | list[str], buckets: int) -> Column:
    """The number of the bucket that a row is in, by its keys or by a number of its own."""
    return F.pmod(F.xxhash64(*by) if isinstance(by, list) else by, F.lit(buckets)).cast("int")


def _write_files(rows: DataFrame, folder: str) -> None:
    rows.withColumn(_FOLDER, F.col(BUCKET)).repartition(BUCKET).write.partitionBy(_FOLDER).parquet(folder)


def _publish(store: Store, after: Manifest) -> bool:
    return store.create(_name(after.version), json.dumps(asdict(after)))


def expire(spark: SparkSession, path: str, grace: float = GRACE) -> None:
    """Removes what the newest version does not need and is older than ``grace`` seconds: manifests by the time
    when the next one replaced them, folders that no manifest names by their last change."""
    store, now = Store(spark, path), time.time()
    there = versions(spark, path)
    data = store.names("data")
    # the first version was replaced before all others, and what is younger than it stays
    if (len(there) < 2 or manifest(spark, path, there[1]).written >= now - grace) and all(c >= now - grace for c in data.values()):
        return
    kept = {v: manifest(spark, path, v) for v in there}
    for v, after in zip(there, there[1:], strict=False):
        if kept[after].written < now - grace:
            store.remove(_name(v))
            del kept[v]
    named = {f for m in kept.values() for f in m.folders.values()}
    for name, changed in data.items():
        folders = [f"data/{name}/{n}" for n in store.names(f"data/{name}") if n.startswith(f"{_FOLDER}=")] if changed < now - grace else []
        if changed < now - grace and not named & {*folders}:
            store.remove(f"data/{name}")
        else:
            for gone in {*folders} - named:
                store.remove(gone)


def upsert(rows: DataFrame, path: str, keys: list[str], order: list[str], buckets: int = 64, source: str | None = None, batch: int | None = None, grace: float = GRACE) -> int:
    """Per key the last row in ``order`` stays, of old and new ones; null is a key like any other."""
    def combine(before: DataFrame, new: DataFrame) -> DataFrame:
        return keep_last(before.unionByName(new, allowMissingColumns=True), [*keys, BUCKET], order)

    return write_buckets(rows, path, keys, buckets, combine, None, source, batch, grace)


def apply_changes(changes: DataFrame, path: str, keys: list[str], buckets: int = 64, source: str | None = None, batch: int | None = None, grace: float = GRACE, by: Column | None = None, layout: str = "", met: list[str] | None = None) -> int:
    """D rows go, A and M rows take the place of those of their keys; keys of changes are unique. Null is a
    key like any other. by, layout, met: as of ``write_buckets``."""
    schema = StructType([f for f in changes.schema if f.name != "change_type"])

    def combine(before: DataFrame, new: DataFrame) -> DataFrame:
        same = [before[k].eqNullSafe(new[k]) for k in [BUCKET, *keys]]
        kept = before.join(new.select(BUCKET, *keys), same, "left_anti")
        return kept.unionByName(new.where("change_type <> 'D'").drop("change_type"), allowMissingColumns=True)

    return write_buckets(changes, path, keys, buckets, combine, schema, source, batch, grace, by, layout, met)
