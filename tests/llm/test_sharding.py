"""Shards against the law that they keep, hot texts, few and odd rows, and files."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm.sharding import OVERHEAD, WHOLE, _splitters, placements, write_shards


def lawful(rows, texts: dict, shards: int) -> None:
    """Sizes, checksums, gapless slots, and sizes of shards that differ from equal by a row or a small group."""
    total, sizes, slots = sum(r.size for r in rows), Counter(), defaultdict(list)
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + OVERHEAD, zlib.crc32(text), "bytes", None)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    room = max(max((r.size for r in rows), default=0), total / shards / WHOLE)
    assert all(0 <= s < shards and abs(sizes[s] - total / shards) <= room for s in range(shards))


@pytest.mark.parametrize("ranges", [None, 7, 1])
def test_even_shards_with_hot_texts(spark, ranges):
    """A third of all rows is one text; the empty text is frequent too. Ranges decide nothing of the result."""
    dice = random.Random(5)
    texts = {i: "hot text " * 20 if i % 3 == 0 else None if i % 7 == 0 else f"text {dice.random()} " * dice.randrange(1, 30) for i in range(4000)}
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, shard string, size int").repartition(5)
    rows = placements(docs, shards=10, ranges=ranges).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    lawful(rows, texts, 10)
    assert sorted(rows) == sorted(placements(docs.repartition(2), shards=10).collect())
    together = defaultdict(set)
    for r in rows:
        together[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for t, s in together.items() if t and not t.startswith("hot")) and len(together[texts[0]]) > 2


def test_overfull_ranges_are_divided(spark):
    frame = spark.range(6000).selectExpr("id AS doc_id", "id", "id AS row", "100L AS size", "CASE WHEN id < 3000 THEN 5L ELSE xxhash64(id) & 1048575 END AS key")
    splitters, sizes, heavy = _splitters(frame, 6000, 600_000, 4, 60)
    assert heavy >= {5} and sum(n for _, n in sizes) == 6000 and sum(b for b, _ in sizes) == 600_000
    assert max(n for _, n in sizes) <= 2 * 6000 / 60 + 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, None), (2, ""), (3, "x" * 100_000)], "doc_id long, text string")
    rows = placements(docs, shards=3).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    assert {r.size for r in rows if r.doc_id == 2} == {OVERHEAD}
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in range(3))
    assert placements(docs.where("doc_id = 9")).isEmpty()
    (one,) = placements(docs.where("doc_id = 2")).collect()
    assert (one.slot, one.text_crc32) == (0, 0) and 0 <= one.shard < 40


def test_written_shards(spark, make_docs, tmp_path):
    texts = [None, "", *(f"text {i} " * (i % 5) for i in range(200)), "same", "same"]
    docs = make_docs(texts)
    write_shards(docs.repartition(3), str(tmp_path / "out"), shards=4, rows_per_file=20)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    want = {(r.doc_id, r.shard, r.slot) for r in placements(docs, shards=4).collect()}
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == want
    assert all(len(list(p.glob("*.parquet"))) >= 2 for p in (tmp_path / "out").glob("shard=*"))
    with pytest.raises(ValueError, match="slot"):
        write_shards(docs.withColumnRenamed("run", "Slot"), str(tmp_path / "no"))
