"""Exact, near and substring dedup, and embeddings, against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embeddings, exact, minhash, substrings
from tidemark.llm.components import components, local_roots


def classes(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_exact(spark, make_docs, odd_texts):
    texts = odd_texts + ["a b", "ab", " a\x0bb ", "a\x1cb", "ab"] * 3
    for fan in (2, 16):
        got = {r.doc_id: r for r in exact.exact_groups(make_docs(texts).repartition(7), fan=fan).collect()}
        groups: dict[str, list[int]] = {}
        for i, t in enumerate(texts):
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(i)
        for bare, of in groups.items():
            keep = min(of, key=lambda i: (-len(texts[i] or ""), i))
            for i in of:
                r = got[i]
                assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(of), i == keep, hashlib.sha256(bare.encode()).hexdigest())
    assert exact.exact_groups(make_docs(["x"]).where("doc_id < 0")).count() == 0


def near_texts(seed=3):
    rng = random.Random(seed)
    out = []
    for size in (6, 12, 40, 150, 600):
        base = [f"t{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(30):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + size // 25)):
                words[rng.randrange(size)] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(words))
    line = " ".join(f"license{i}" for i in range(15))
    return out + [line + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 60))) for _ in range(120)]


def shingle_set(text):
    words = tuple((text or "").encode().lower().split())
    if not words:
        return set()
    return {words} if len(words) < 5 else {words[i : i + 5] for i in range(len(words) - 4)}


def copies(n, seed=11, words=600):
    """A text, copies of it with one to three words of their own, and six with much more."""
    rng = random.Random(seed)
    base = [f"c{rng.randrange(5000)}" for _ in range(words)]
    out = [" ".join(base)]
    for k in range(n - 1):
        mine = list(base)
        for _ in range(25 if k < 6 else rng.choice([1, 1, 2, 3])):
            mine[rng.randrange(words)] = f"o{rng.randrange(10**7)}"
        out.append(" ".join(mine))
    rng.shuffle(out)
    return out


def test_a_cluster_moves_in_proportion_to_its_size(spark, make_docs, monkeypatch):
    """Rows that pairs of blocks move: fewer than the lists have entries, and than the cluster has documents."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    monkeypatch.setattr(minhash, "WIDE", 2)
    real, moved = minhash._in_blocks, []
    monkeypatch.setattr(minhash, "_in_blocks", lambda rows, *a: moved.append((out := real(rows, *a))) or out)
    for n in (300, 1200):
        texts = copies(n)
        moved.clear()
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(make_docs(texts)).collect()}
        assert sum(m.count() for m in moved if "value" in m.columns) < n * minhash.LOW
        assert sum(m.count() for m in moved if "family" in m.columns) < n / 4
        if n == 300:
            sets = [shingle_set(t) for t in texts]
            links = [(i, j) for i in range(n) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
            assert [got[i] for i in range(n)] == classes(n, links)


@pytest.mark.parametrize(("block", "wide"), [(1024, 8), (16, 8), (16, 1)])
def test_near(spark, make_docs, odd_texts, block, wide, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "WIDE", wide)
    texts = odd_texts + near_texts()
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert len(links) > 100
    want = classes(len(texts), links)
    for r in minhash.near_duplicates(make_docs(texts)).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(make_docs(["x"]).where("doc_id < 0")).count() == 0
    assert minhash.near_duplicates(make_docs([None, "", " "])).where("kept").count() == 3


def brute_repeats(texts):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        mask = bytearray(len(b))
        for p in range(len(b) - substrings.LENGTH + 1):
            w = b[p : p + substrings.LENGTH]
            if w in seen:
                mask[p : p + substrings.LENGTH] = b"\x01" * substrings.LENGTH
            seen.add(w)
        left = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        runs = sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))
        out.append((len(b), sum(mask), runs, hashlib.sha256(left).hexdigest()))
    return out


def test_substrings(spark, make_docs, odd_texts, monkeypatch):
    rng = random.Random(5)
    passages = [" ".join(f"p{rng.randrange(300)}" for _ in range(40)) for _ in range(6)]
    texts = list(odd_texts)
    for _ in range(120):
        parts = [" ".join(f"q{rng.randrange(10**5)}" for _ in range(rng.randrange(0, 30)))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) // 2)
            parts += [p[a : a + rng.randrange(60, len(p))], " ".join(f"r{rng.randrange(10**5)}" for _ in range(5))]
        texts.append("é".join(parts))
    texts += ["ab" * 300, "ab" * 100 + "c", "z" * 101, "z" * 100, "z" * 99]
    want = brute_repeats(texts)
    for segment in (1_000_000, 500):
        monkeypatch.setattr(substrings, "SEGMENT", segment)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(make_docs(texts).repartition(5)).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert substrings.remove_repeats(make_docs(["x"]).where("doc_id < 0")).count() == 0


def test_a_line_in_very_many_texts_is_dealt_by_windows(spark, make_docs, monkeypatch):
    rng = random.Random(8)
    line = "Licensed under the terms of the common gram, see the file."
    words = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    texts = [f"{words(rng.randrange(0, 25))} {line} {words(rng.randrange(0, 25))}" for _ in range(200)]
    texts += [t[rng.randrange(0, 60) :] + words(3) for t in texts[::3]] + [line * 4, line + texts[0], None, ""]
    want = brute_repeats(texts)
    assert sum(w[1] > 0 for w in want) > 50
    docs = make_docs(texts)
    docs = docs.unionByName(docs.limit(5)).repartition(5)
    for heads, sampled in ((1, True), (10, True), (10, False), (substrings.HEADS, True)):
        with monkeypatch.context() as m:
            if not sampled:
                m.setattr(substrings, "common_grams", lambda *_: np.empty(0, np.uint64))
            got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(docs, heads).collect()}
        assert [got[i] for i in range(len(texts))] == want

    lines = substrings.id_and_text(docs.where("doc_id < 200"))  # nothing but the line is shared

    def largest(common, heads):  # bytes of a shard that are compared in one place, in each of the two steps
        shards, out = 4, []
        tuples = substrings._suffix_tuples(lines, shards, common)
        found = substrings._resolved(tuples, shards, heads)
        moved = substrings._stretches(lines, found.where(f"kind = {substrings._ASKED}"), shards)
        for rows in (tuples, moved):
            sizes: dict[int, int] = {}
            for r in rows.where(f"kind <> {substrings._SPANS}").collect():
                sizes[r.shard] = sizes.get(r.shard, 0) + len(r.packed)
            out.append((max(sizes.values(), default=0), len(sizes)))
        return out

    none = substrings.common_grams(lines, 10**5, substrings.HEADS)
    some = substrings.common_grams(lines, 10**5, 10)
    assert len(none) == 0 < len(some)
    whole, late, early = largest(none, substrings.HEADS), largest(none, 10), largest(some, 10)
    # told in the shard of the gram, or before any tuple moves: then windows are dealt, and no stretch is asked for
    assert whole[1][1] <= 4 < late[1][1] and late[1][0] < whole[1][0], (whole, late)
    assert early[0][1] > 4 and early[1][0] < whole[1][0] / 2, (whole, early)


def test_a_repeated_row_keeps_its_text(spark, make_docs):
    docs = make_docs(["k" + "lm " * 60])
    rows = substrings.remove_repeats(docs.unionByName(docs)).collect()
    assert len(rows) == 2 and len({r.kept_sha256 for r in rows}) == 1 and rows[0].n_removed < rows[0].n_bytes


@pytest.mark.parametrize(("cell", "block"), [(4096, 2048), (40, 16)])
def test_embeddings(spark, cell, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[100:200] = x[rng.integers(0, 20, 100)] + 0.12 * rng.normal(size=(100, 8))
    x[200:240] = x[0]
    rows = [(i, [float(v) for v in x[i]], int(i % 3 == 0)) for i in range(300)]
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] + [1.0] * 7, 1), (303, [None] + [1.0] * 7, 1), (304, [float("inf")] + [1.0] * 7, 1), (305, rows[0][1], None), (306, [], 1), (307, [-0.0] * 8, 0)]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, weight int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= embeddings.THRESHOLD
    links = [(i, j) for i in range(300) for j in range(i) if near[i, j] and rows[i][2] == rows[j][2]]
    want = classes(308, links)
    n = [0] * 308
    for i, j in links:
        n[i] += 1
        n[j] += 1
    got = embeddings.near_duplicates(frame, cell=cell, block=block).collect()
    assert len(got) == 308
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)
    assert embeddings.near_duplicates(frame.where("vec_id < 0")).count() == 0


def test_two_levels_of_cells_lose_no_link():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(400, 6)), rng.normal(size=(60, 6)).repeat(20, 0) + 0.15 * rng.normal(size=(1200, 6))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = embeddings._two_levels(unit[::2], len(unit), 20, 8)
    assert len(centres[0]) == 8 and sum(map(len, centres[1])) > 40
    rows, cells, home = embeddings.visits(unit, centres, embeddings.THRESHOLD)
    at = dict(zip(rows[home].tolist(), cells[home].tolist(), strict=True))
    assert len(at) == home.sum() == len(unit)
    seen = set(zip(rows.tolist(), cells.tolist(), strict=True))
    i, j = np.nonzero(unit @ unit.T >= embeddings.THRESHOLD)
    assert len(i) > 10_000 and all((a, at[b]) in seen for a, b in zip(i.tolist(), j.tolist(), strict=True))
    assert len(seen) < 0.7 * len(unit) * sum(map(len, centres[1]))


def test_shards_of_regular_ids_are_even(spark, make_docs):
    """Ids that are multiples of the number of shards, negative ones too, go to all shards."""
    ids = np.arange(-500, 500, dtype=np.int64) * 24
    counts = np.bincount(substrings._shard_of(ids, 24), minlength=24)
    assert len(counts) == 24 and counts.max() < 2 * 1000 / 24
    rng = random.Random(3)
    docs = make_docs(["".join(rng.choices("abc ", k=300)) for _ in range(40)]).withColumn("doc_id", F.col("doc_id") * 4)
    packed = substrings._packed_texts(docs.select("doc_id", "text"), 4)
    assert packed.select("shard").distinct().count() == 4


@pytest.mark.parametrize("clustered", [True, False])
def test_cells_that_pay(spark, clustered):
    """Rows dealt to pairs of blocks: at most a quarter of those of plain blocks where vectors form clusters, never
    more; no link is lost. The label of the figures in the README has 20,000 and 200,000 vectors."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 24))
    if clustered:
        x = rng.normal(size=(30, 24))[rng.integers(0, 30, 6000)] + 0.2 * rng.normal(size=(6000, 24))
    block, frame = 256, spark.createDataFrame([(i, v.tolist(), "a", 24, 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string, dim int, weight long")
    centres = embeddings.fit_centres(frame, 1000, block=block)
    _, sizes = embeddings.placed_in_cells(frame, centres, embeddings.THRESHOLD, block)
    own, others = (np.array(c) for c in zip(*[(r.own, r.others) for r in sizes.collect()], strict=True))
    plain = embeddings.dealt_rows(np.array([6000]), np.array([0]), block)
    assert own.sum() == 6000 and embeddings.dealt_rows(own, others, block) <= (plain / 4 if clustered else plain)
    assert bool(centres) == clustered
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= embeddings.THRESHOLD).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(frame, cell=1000, block=block).collect()}
    assert [got[i] for i in range(6000)] == near.tolist() and (near.sum() > 1000) == clustered


def test_cells_that_do_not_pay_are_given_up(spark):
    """Centres that all vectors visit, which an unlucky sample may choose, are found out by counting."""
    rng = np.random.default_rng(3)
    frame = spark.createDataFrame([(i, rng.normal(size=3).tolist(), "a", 3, 1) for i in range(400)], "vec_id long, embedding array<double>, label string, dim int, weight long")
    close = embeddings._unit((np.ones((20, 3)) + 0.01 * rng.normal(size=(20, 3))).tolist())
    placed, sizes = embeddings.placed_in_cells(frame, {("a", 3): (close, [c[None] for c in close])}, 0.93, 400)
    assert [(r.own, r.others) for r in sizes.collect()] == [(400, 0)] and placed.count() == 400


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(150)] + [(500, x) for x in range(501, 560)] + [(7, 7)]
    want = classes(600, edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for e in {x for e in edges for x in e}:
        assert got.get(e, e) == want[e]
    a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
    assert local_roots(600, a, b).tolist() == want
