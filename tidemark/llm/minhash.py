"""Near-dedup by bottom-k sketches from one hash function.

A document's set is its distinct word shingles under one 64-bit hash; its sketch is the K least
values. Candidates come from inverted lists: each document enters the lists of its ``LOW`` least
values. Of two sets with a Jaccard similarity of J, each of the least values of their union is in
both with probability J, so they miss each other in all lists with probability (1 - J)^LOW, which
is below 1e-8 at J = 0.85 and 1e-7 at J = 0.8. Within a list, the overlap of sketches is counted and the union's sketch
estimates J; pairs whose estimate is six standard errors below the threshold go. What is left links
documents to families, and within a family the full sets decide, exactly.

Scale: equal sets are one representative from the start. In long lists, sets meet only sets of like
size: a band of sizes and the next one up, which is as far as linked sets can be apart. Bands are cut
into blocks of bounded size, and a task holds two. A band of more than ``WIDE`` blocks is first dealt to
tasks each of which lets one leader stand for the sketches that are nearly its own; leaders meet under a
filter that is loosened by the radius of what they stand for and, where they are still very many, only
if they have a second least value in common. So a cluster of n near copies moves n sketches, whatever n.

Full sets of families meet in blocks in the same way. In a family of more than ``WIDE`` blocks all sets are first compared with one
of them, the pivot: the one that is most like what many of them have in common. Those that it links
are settled among themselves; Jaccard distances are a metric, so another pair can only be linked if
their distances from the pivot are about alike, and what is left is divided into rings around the
pivot, which are families of their own. A family of near copies of one text is settled by one
comparison a document. Rings that do not shrink are cut into blocks, and a task holds two.

A pair of documents is looked at only in the list of their least common value. Tasks emit a spanning
forest of the links they find (each member with the least of its local component), never pairs, so
what moves is linear in documents. Texts are read again for the members of families alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import PerWord
from tidemark.llm.common import durable, id_and_text, spread_join, whole_runs
from tidemark.llm.components import components, local_roots

WORDS = 5
#: Links are pairs with 100 * intersection >= percent * union; this is op3's percent, by contract.
PERCENT = 85
#: Values of a sketch, and how many of them are inverted.
K, LOW = 96, 10
#: Documents of a list or family that make a block, and blocks of which all pairs meet; where there are
#: more, leaders and pivots come first.
BLOCK, WIDE = 1024, 8
#: A leader stands for sketches of its list that share this part of their values with it, and the filter
#: of pairs of leaders allows for this distance of their sets (six standard errors of the estimate apart).
LIKE, RADIUS = 0.95, 0.15
#: Values after the list's own, one of which sets of a long list must have in common too.
NEXT = 12
#: Times that what is left of a large family is divided around pivots.
PIVOTS = 4
#: Sets of a family whose blocks would hold more shingles than this are cut finer.
SHINGLES = 4_000_000
_TILE = 4096
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class _Hashes(PerWord):
    def __init__(self) -> None:
        super().__init__(_word_hash)


_HASHES = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that leaves no trace of their order."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The sorted hashes of the text's distinct shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone are lowered
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < WORDS:
        return np.array([_word_hash(b" ".join(words))], np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    total = h[: n - WORDS + 1] * _MULTIPLIERS[0]
    for i in range(1, WORDS):
        total += h[i : n - WORDS + 1 + i] * _MULTIPLIERS[i]
    return np.unique(_mixed(total))


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, digest of the set, its ``LOW`` least values, and its sketch as
    the upper halves of the ``K`` least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, low, sketch = [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py())
                n.append(len(s))
                digest.append(hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest())
                low.append(s[:LOW].astype(np.int64))
                sketch.append((s[:K] >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(low, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "low", "sketch"],
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, low array<long>, sketch binary")


def _in_blocks(rows: DataFrame, key: list[str], blocks: str, guests: str | None = None, guest: Column | None = None) -> DataFrame:
    """Every row once for each pair of blocks of its group that its own block is in: columns key,
    first, second_block (blocks of the pair) and block (its own). ``blocks`` and ``guests``: the group's
    numbers of blocks; two blocks of guests are no pair."""
    among = F.pmod(F.xxhash64("doc_id"), F.greatest(F.col("_n"), F.lit(1)))
    dealt = rows.withColumn("_n", F.col(blocks)).withColumn("block", among).withColumn("_last", F.col("_n") - 1)
    if guests:
        visiting = guest & (F.col(guests) > 0)
        own = F.when(visiting, F.col("_n") + F.pmod(F.xxhash64("doc_id"), F.greatest(F.col(guests), F.lit(1)))).otherwise(F.col("block"))
        dealt = dealt.withColumn("block", own).withColumn("_last", F.when(visiting, F.col("_n") - 1).otherwise(F.col("_n") + F.col(guests) - 1)).drop(guests)
    return (
        dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), "_last")))
        .withColumn("first", F.least("block", "_other"))
        .withColumn("second_block", F.greatest("block", "_other"))
        .drop("_n", "_last", "_other", blocks)
        .repartition(*key, "first", "second_block")
        .sortWithinPartitions(*key, "first", "second_block", "doc_id")
    )


def _products(columns: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """How many values each two of n rows have in common, from (row, value) entries."""
    out = np.zeros((n, n), np.float32)
    values, at, count = np.unique(columns, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[at]
    cols, rows = place[at[keep]], rows[keep]
    order = np.argsort(cols, kind="stable")
    cols, rows = cols[order], rows[order]
    edges = np.searchsorted(cols, np.arange(0, int(shared.sum()) + _TILE, _TILE))
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            tile = np.zeros((n, int(cols[b - 1] - cols[a]) + 1), np.float32)
            tile[rows[a:b], cols[a:b] - cols[a]] = 1
            out += tile @ tile.T
    return out


def _estimates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The Jaccard estimate of each pair of sketches (rows, padded with the greatest value): the
    share of the union's K least values that both have."""
    merged = np.sort(np.concatenate([x, y], 1), 1)
    real = merged != np.uint32(0xFFFFFFFF)
    new = np.ones(merged.shape, bool)
    new[:, 1:] = merged[:, 1:] != merged[:, :-1]
    within = (np.cumsum(new & real, 1) <= K) & real
    both = (~new & within).sum(1)
    return both / np.maximum((new & within).sum(1), 1)


def _least_estimate(similarity: np.ndarray | float) -> np.ndarray:
    """The estimate that sets of a similarity reach, but for six standard errors."""
    return similarity - 6 * (similarity * (1 - similarity) / K) ** 0.5


class _List:
    """Sketches of one list, or of two blocks of it, in rows; a list's value is None where the list is one
    of leaders, which may meet in any of their lists."""

    def __init__(self, table: pa.Table, a: int, b: int) -> None:
        part = table.slice(a, b - a)
        self.ids, self.sizes = part.column("doc_id").to_numpy(), part.column("n_shingles").to_numpy()
        packed = part.column("sketch").to_pylist()
        self.lengths = np.array([len(p) // 4 for p in packed])
        self.values = np.frombuffer(b"".join(packed), "<u4")
        self.rows = np.repeat(np.arange(b - a), self.lengths)
        self.common = _products(self.values, self.rows, b - a)
        self.large = np.maximum.outer(self.sizes.astype(np.float32), self.sizes.astype(np.float32))

    def leaders(self) -> np.ndarray:
        """The row that stands for each row: the first that is nearly the same, or itself."""
        like = self.common >= LIKE * np.minimum(K, self.large)
        of = np.full(len(self.ids), -1)
        for i in range(len(of)):
            if of[i] < 0:
                of[like[i] & (of < 0)] = i
                of[i] = i
        return of

    def next_values(self, value: int) -> list[np.ndarray]:
        """Of each row, the ``NEXT`` values after the list's own."""
        ends = np.cumsum(self.lengths)
        own = (value & 0xFFFFFFFFFFFFFFFF) >> 32
        out = []
        for end, n in zip(ends.tolist(), self.lengths.tolist(), strict=True):
            mine = self.values[end - n : end]
            at = int(np.searchsorted(mine, own, "right"))
            out.append(mine[at : at + NEXT].astype(np.int64))
        return out

    def links(self, value: int, blocks: np.ndarray, home: np.ndarray, covers: np.ndarray, low: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(member, least of its local component) for the candidates."""
        n = len(self.ids)
        # pairs that share a lesser value than this list's meet in that value's list, and two visitors of a
        # band of sizes in the band that they are of
        lesser, low_rows = np.concatenate(low), np.repeat(np.arange(n), [len(x) for x in low])
        before = lesser.astype(np.uint64) < np.uint64(value & 0xFFFFFFFFFFFFFFFF)
        ok = (_products(lesser[before], low_rows[before], n) == 0) & (home[:, None] | home[None, :])
        # a leader meets whatever those that it stands for may be linked with
        standing = covers[:, None].astype(np.int8) + covers[None, :]
        ok |= standing > 0
        similarity = percent / 100 - RADIUS * np.arange(3)
        least = _least_estimate(similarity)
        small = np.minimum.outer(self.sizes.astype(np.float32), self.sizes.astype(np.float32))
        for k in np.unique(standing).tolist():
            ok &= (standing != k) | ((small >= (similarity[k] - 1e-6) * self.large) & (self.common >= np.floor(least[k] * np.minimum(K, self.large))))
        del small
        if blocks.min() != blocks.max():
            ok &= blocks[:, None] != blocks[None, :]
        a, b = np.nonzero(np.triu(ok, 1))
        padded = np.full((n, K), 0xFFFFFFFF, np.uint32)
        padded[self.rows, np.arange(len(self.values)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)] = self.values
        roots = None
        for at in range(0, len(a), 20_000):
            x, y = a[at : at + 20_000], b[at : at + 20_000]
            if roots is not None:  # links within a component add nothing
                apart = roots[x] != roots[y]
                x, y = x[apart], y[apart]
            good = _estimates(padded[x], padded[y]) >= least[standing[x, y]]
            roots = local_roots(n, x[good], y[good], roots)
        return _forest(self.ids, roots)


def _forest(ids: np.ndarray, roots: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if roots is None:
        return ids[:0], ids[:0]
    member = roots != np.arange(len(ids))
    return ids[member], ids[roots[member]]


_EDGES = "a long, b long"


def _edge_batch(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in parts]) if parts else np.empty(0, np.int64)
    b = np.concatenate([y for _, y in parts]) if parts else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _runs(table: pa.Table, keys: list[str]) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of equal keys in sorted rows."""
    n = table.num_rows
    change = np.zeros(n, bool)
    for k in keys:
        c = table.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    starts = np.concatenate([[0], np.nonzero(change)[0], [n]])
    yield from zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)


def _led(listed: DataFrame) -> DataFrame:
    """Long lists dealt to tasks, each with few leaders: value, band, doc_id, n_shingles, home, leader (its
    own id for a leader), covers (it stands for others), next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["value", "band", "part"]
        for table in whole_runs(batches, keys):
            values = table.column("value").to_numpy()
            for a, b in _runs(table, keys):
                part = _List(table, a, b)
                of = part.leaders()
                covers = np.bincount(of, minlength=b - a) > 1
                some = table.slice(a, b - a)
                arrays = [some.column(c).combine_chunks() for c in ("value", "band", "doc_id", "n_shingles", "home")]
                arrays += [pa.array(part.ids[of]), pa.array(covers), pa.array(part.next_values(int(values[a])), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["value", "band", "doc_id", "n_shingles", "home", "leader", "covers", "next"])

    dealt = listed.repartition("value", "band", "part").sortWithinPartitions("value", "band", "part", "doc_id")
    return dealt.mapInArrow(run, "value long, band long, doc_id long, n_shingles long, home boolean, leader long, covers boolean, next array<long>")


def _headed(wide: DataFrame, sketch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaders of wide bands with the blocks that they are to meet in, edges to them from the others)."""
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("parts"))
    led = durable(_led(wide.withColumn("part", part).join(sketch, "doc_id")))
    heads = led.where("leader = doc_id")
    counts = heads.groupBy("value", "band").agg(F.count("*").alias("heads"))
    # leaders that would be copied less by their next values than by pairs of blocks
    second = F.explode(F.when(F.col("heads") > 2 * NEXT * BLOCK, F.col("next")).otherwise(F.array(F.lit(-1).cast("long"))))
    among = durable(spread_join(heads, counts, ["value", "band"], "doc_id").select("value", "band", second.alias("second"), "doc_id", "home", "covers"))
    keys = ["value", "band", "second"]
    blocks = among.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    placed = spread_join(among, blocks, keys, "doc_id").where("blocks IS NOT NULL").select(*keys, "doc_id", "home", "covers", "blocks")
    return placed, led.where("leader <> doc_id").select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))


def candidates(marks: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) whose components are the families of documents that may be linked. marks: one
    row of ``sketches`` per distinct set."""
    entries = marks.select("doc_id", "n_shingles", F.explode("low").alias("value"))
    sizes = durable(entries.groupBy("value").agg(F.count("*").alias("size")).where("size > 1"))
    none, one = F.lit(-1).cast("long"), F.lit(1).cast("long")
    short = entries.join(sizes.where(F.col("size") <= BLOCK), "value")
    placed = short.select("value", none.alias("band"), none.alias("second"), "doc_id", F.lit(True).alias("home"), F.lit(False).alias("covers"), one.alias("blocks"))
    sketch, edges = marks.select("doc_id", "n_shingles", "low", "sketch"), None
    if not (long_ := sizes.where(F.col("size") > BLOCK)).isEmpty():
        # linked sets are less than a band apart in size; the margin is for rounding
        band = F.floor(F.log("n_shingles") / (-1.001 * math.log(percent / 100)))
        both = F.array(F.struct(band.alias("band"), F.lit(True).alias("home")), F.struct((band + 1).alias("band"), F.lit(False).alias("home")))
        banded = durable(spread_join(entries, long_, "value", "doc_id").where("size IS NOT NULL").select("value", "doc_id", F.inline(both)))
        parts = banded.groupBy("value", "band").agg(F.ceil(F.count("*") / BLOCK).alias("parts"), F.count("*").alias("n")).where("n > 1")
        dealt = durable(spread_join(banded, parts, ["value", "band"], "doc_id").where("parts IS NOT NULL"))
        placed = placed.unionByName(dealt.where(F.col("parts") <= WIDE).select("value", "band", none.alias("second"), "doc_id", "home", F.lit(False).alias("covers"), F.col("parts").alias("blocks")))
        if not (wide := dealt.where(F.col("parts") > WIDE)).isEmpty():
            headed, edges = _headed(wide, sketch)
            placed = placed.unionByName(headed)
    keys = ["value", "band", "second"]
    met = _in_blocks(placed.join(sketch, "doc_id"), keys, "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [*keys, "first", "second_block"]
        for table in whole_runs(batches, at):
            found = []
            own, values = table.column("block").to_numpy(), table.column("value").to_numpy()
            low, home, covers = table.column("low").to_numpy(), table.column("home").to_numpy().astype(bool), table.column("covers").to_numpy().astype(bool)
            for a, b in _runs(table, at):
                if b - a > 1:
                    found.append(_List(table, a, b).links(int(values[a]), own[a:b], home[a:b], covers[a:b], list(low[a:b]), percent))
            yield _edge_batch(found)

    found = met.mapInArrow(run, _EDGES)
    return found if edges is None else found.unionByName(edges)


def _family_links(ids: np.ndarray, blocks: np.ndarray, visits: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, least of its local component) for the links of one family, or two blocks of it, from
    full sets. Those that visit it from one and the same ring are no pairs here."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    if n <= 8:
        both = np.zeros((n, n))
        for i in range(n):
            for j in range(i + 1, n):
                if 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j]):
                    both[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        both = _products(np.concatenate(sets), np.repeat(np.arange(n), sizes), n)
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    linked &= (visits[:, None] & visits[None, :]) == 0
    if blocks.min() != blocks.max():
        linked &= blocks[:, None] != blocks[None, :]
    a, b = np.nonzero(np.triu(linked, 1))
    return _forest(ids, local_roots(n, a, b))


def _blocks_of(rows: DataFrame, level: int = -1) -> DataFrame:
    """family, the numbers of blocks that its members and its guests of a level make (1 and 0 if all can meet
    in one task), and whether these are few (small)."""
    guest = _guest(level)

    def of(which: Column) -> Column:
        return F.greatest(F.ceil(F.count_if(which) / BLOCK), F.ceil(2 * F.sum(F.when(which, F.col("n_shingles")).otherwise(0)) / SHINGLES)).cast("long")

    counts = rows.groupBy("family").agg(of(F.lit(True)).alias("all"), of(~guest).alias("members"), of(guest).alias("guests"))
    return counts.select("family", F.when(F.col("all") == 1, F.col("all")).otherwise(F.col("members")).alias("blocks"), F.when(F.col("all") == 1, 0).otherwise(F.col("guests")).cast("long").alias("guests"), (F.col("all") <= WIDE).alias("small"))


def _guest(level: int) -> Column:
    """Rows that visit their ring from the one before, by the pivot of a level."""
    return (F.col("visits").bitwiseAND(F.lit(1 << level)) != 0) if level >= 0 else F.lit(False)


def _met(rows: DataFrame, percent: int, level: int = -1) -> DataFrame:
    """Edges of the links within families. rows: family, blocks, guests, doc_id, visits, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["family", "first", "second_block"]
        for table in whole_runs(batches, keys):
            found = []
            ids, own, visits, packed = table.column("doc_id").to_numpy(), table.column("block").to_numpy(), table.column("visits").to_numpy(), table.column("packed")
            for a, b in _runs(table, keys):
                if b - a > 1:
                    found.append(_family_links(ids[a:b], own[a:b], visits[a:b], [np.frombuffer(packed[i].as_py(), "<u8") for i in range(a, b)], percent))
            yield _edge_batch(found)

    rows = rows.select("family", "blocks", "guests", "doc_id", "visits", "packed")
    return _in_blocks(rows, ["family"], "blocks", "guests", _guest(level)).mapInArrow(run, _EDGES)


def _cores(rows: DataFrame) -> DataFrame:
    """family and what most of some of its members have in common. Which members does not matter: a pivot
    is chosen by it, and any pivot gives the same links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: dict[int, list[np.ndarray]] = {}
            for family, packed in zip(batch.column("family").to_pylist(), batch.column("packed"), strict=True):
                of.setdefault(family, []).append(np.frombuffer(packed.as_py(), "<u8"))
            cores = []
            for sets in of.values():
                values, n = np.unique(np.concatenate(sets), return_counts=True)
                cores.append(values[2 * n > len(sets)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(list(of), pa.int64()), pa.array([len(x) for x in of.values()], pa.int64()), pa.array(cores, pa.binary())], names=["family", "n", "core"])

    return rows.mapInArrow(run, "family long, n long, core binary").groupBy("family").agg(F.max_by("core", "n").alias("with"))


def _compared(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Every row with its family's set of ``sets`` (family, with): family, doc_id, visits, n_shingles, shared
    (shingles that both have), other (shingles of that set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, sizes = [], []
            last, mine = None, np.empty(0, np.uint64)
            for family, packed, of in zip(batch.column("family").to_pylist(), batch.column("packed"), batch.column("with"), strict=True):
                if family != last:
                    last, mine = family, np.frombuffer(of.as_py(), "<u8")
                shared.append(len(np.intersect1d(np.frombuffer(packed.as_py(), "<u8"), mine, assume_unique=True)))
                sizes.append(len(mine))
            arrays = [batch.column(c) for c in ("family", "doc_id", "visits", "n_shingles")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(shared, pa.int64()), pa.array(sizes, pa.int64())], names=["family", "doc_id", "visits", "n_shingles", "shared", "other"])

    return spread_join(rows, sets, "family", "doc_id").mapInArrow(run, "family long, doc_id long, visits int, n_shingles long, shared long, other long")


_UNION = "(n_shingles + other - shared)"


def _around(rows: DataFrame, packed: DataFrame) -> DataFrame:
    """``_compared`` of every row with its family's pivot, and pivot. rows: family, doc_id, visits, n_shingles;
    packed: doc_id and its set."""
    whole = durable(rows.join(packed, "doc_id"))
    like = _compared(whole, _cores(whole)).groupBy("family").agg(F.min_by("doc_id", F.struct(F.expr(f"1 - shared / {_UNION}"), "doc_id")).alias("pivot"))
    pivots = durable(like.join(packed.select(F.col("doc_id").alias("pivot"), F.col("packed").alias("with")), "pivot"))
    return spread_join(_compared(whole, pivots.select("family", "with")), pivots.select("family", "pivot"), "family", "doc_id")


def _rings(around: DataFrame, level: int, percent: int) -> DataFrame:
    """What the pivots leave to compare: family (of a ring), doc_id, visits, n_shingles.

    Sets that a pivot links are in ring 0 and are no pairs any more; the others are in rings of the width
    of a link's distance. Linked sets are in one ring or in neighbouring ones, so each set is a member of
    its own ring and visits the next if that has members it may reach; two visitors are no pair there.
    """
    reach = 1 - percent / 100
    placed = around.withColumn("distance", F.expr(f"1 - shared / {_UNION}"))
    ring = F.when(F.expr(f"100 * shared >= {percent} * {_UNION}"), 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("distance") / (reach * 1.000001)).cast("int")))
    placed = placed.withColumn("ring", ring)
    homes = placed.where("ring > 0").select("family", "ring", "doc_id", "visits", "n_shingles")
    nearest = placed.where("ring > 0").groupBy("family", "ring").agg(F.min("distance").alias("least"))
    guests = spread_join(placed.withColumn("ring", F.col("ring") + 1), nearest, ["family", "ring"], "doc_id").where(F.col("distance") >= F.col("least") - reach - 1e-6)
    guests = guests.select("family", "ring", "doc_id", F.col("visits").bitwiseOR(F.lit(1 << level)).alias("visits"), "n_shingles")
    return homes.unionByName(guests).select(F.xxhash64("family", "ring", F.lit(level)).alias("family"), "doc_id", "visits", "n_shingles")


def links(docs: DataFrame, members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) whose components are those of the exact links. members: doc_id, n_shingles,
    family; one document per distinct set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [shingles(t.as_py()).astype("<u8").tobytes() for t in batch.column("text")]
            arrays = [batch.column(c) for c in ("doc_id", "family", "visits", "blocks", "guests")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(packed, pa.binary())], names=["doc_id", "family", "visits", "blocks", "guests", "packed"])

    def sets(of: DataFrame) -> DataFrame:
        texts = id_and_text(docs).join(of, "doc_id").dropDuplicates(["doc_id"])
        return texts.mapInArrow(run, "doc_id long, family long, visits int, blocks long, guests long, packed binary")

    members = members.withColumn("visits", F.lit(0))
    sized = durable(spread_join(members, _blocks_of(members), "family", "doc_id"))
    edges = _met(sets(sized.where("small")), percent)
    if sized.where("NOT small").isEmpty():
        return edges
    packed = durable(sets(sized.where("NOT small")).select("doc_id", "packed"))
    rows = sized.where("NOT small").select("family", "doc_id", "visits", "n_shingles")
    for level in range(PIVOTS):
        around = durable(_around(rows, packed))
        linked = F.expr(f"100 * shared >= {percent} * {_UNION} AND doc_id <> pivot")
        edges = edges.unionByName(around.where(linked).select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")))
        rings = durable(_rings(around, level, percent))
        if rings.isEmpty():
            return edges
        left = durable(spread_join(rings, _blocks_of(rings, level), "family", "doc_id"))
        last = level == PIVOTS - 1
        edges = edges.unionByName(_met(left.where("small" if not last else "true").join(packed, "doc_id"), percent, level))
        rows = left.where("NOT small").select("family", "doc_id", "visits", "n_shingles")
        if last or rows.isEmpty():
            return edges
    return edges


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept, by links of ``percent`` or more.

    Null and empty texts have no shingles and link with nothing; rows without an id are left out, as
    links need ids. Rows that repeat an id are one document with the text of either. An empty table
    gives none; other columns are ignored.
    """
    rows = durable(sketches(docs.where(F.col("doc_id").isNotNull())))
    full = rows.where("n_shingles > 0")
    # equal sets have equal sketches
    first = full.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("low").alias("low"), F.first("sketch").alias("sketch"))
    marks = durable(first)
    family = components(candidates(marks, percent))
    heads = family.select(F.col("component").alias("doc_id"), F.col("component").alias("family")).distinct()
    members = family.select(F.col("node").alias("doc_id"), F.col("component").alias("family")).unionByName(heads)
    found = components(links(docs, durable(members.join(marks.select("doc_id", "n_shingles"), "doc_id")), percent))
    named = marks.select("digest", F.col("doc_id").alias("node")).join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("class"))
    out = spread_join(rows.select("doc_id", "n_shingles", "digest"), named, "digest", "doc_id")
    component = F.when(F.col("n_shingles") > 0, F.col("class")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id, least(d.doc_id, coalesce(m.b, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""
