"""Collocations against plain counting of all phrases, at thresholds that small texts reach."""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import phrases
from tidemark.llm.phrases import Words, collocations

UPPER = {c: c + 32 for c in range(65, 91)}


def plain(rows, longest: int, least: int, top: int, share: int) -> list[tuple]:
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        of = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            words = re.findall(r"[^ \t]+", piece)
            of.update(tuple(words[i : i + k]) for i in range(len(words)) for k in range(1, longest + 1) if i + k <= len(words))
    out = []
    for lang, of in counts.items():
        n = sum(f for p, f in of.items() if len(p) == 1)
        candidates = {p: f for p, f in of.items() if len(p) > 1 and f >= least}
        dropped = {p[i : i + k] for p, f in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * f >= share * of[p[i : i + k]]}
        scored = []
        for p, a in candidates.items():
            if p not in dropped:
                score, cut = min((1000 * a * n // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), of[p[:cut]], of[p[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -score) for i, (score, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["Wörter", "É", "ÉA", "éa", "x y", "漢字"]
    out = []
    for lang in ("en", "de", None, "und", ""):
        for _ in range(120):
            words = [dice.choice(vocabulary) for _ in range(dice.randrange(0, 40))]
            out.append((lang, "".join(w + dice.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ! "]) for w in words)))
    out += [("en", "A license line that MANY texts share, word for word")] * 60 + [("en", "hot hot hot hot hot hot hot hot")] * 9
    return out + [(None, None), ("fr", ""), ("it", " \t\n.,"), ("en", "w1 " * 3000), ("long", "z" * 100_000 + " " + "z" * 100_000)]


@pytest.mark.parametrize(("longest", "least", "top", "share"), [(5, 9, 2000, 100), (5, 20, 7, 100), (3, 5, 50, 60), (2, 3, 2000, 100), (7, 5, 2000, 90)])
def test_against_plain_counting(spark, rows, monkeypatch, longest, least, top, share):
    monkeypatch.setattr(phrases, "SLICE", 20_000)
    monkeypatch.setattr(phrases, "RUN", 3_000)
    docs = spark.createDataFrame([(t, g, "x", 1, 2) for g, t in rows], "text string, lang string, w1 string, n int, p int").repartition(3)
    got = [tuple(r) for r in collocations(docs, longest, least, top, share).collect()]
    assert sorted(got) == plain(rows, longest, least, top, share) and len(got) > 5


def test_nothing_to_count(spark):
    docs = spark.createDataFrame([("en", "a b"), ("en", None)], "lang string, text string")
    assert collocations(docs).isEmpty() and collocations(docs.where("text = ''")).isEmpty()
    (row,) = collocations(docs, least=1).collect()
    assert tuple(row) == ("en", 1, "a b", 1, 1, 1, 2, 2000)


def test_scores_beyond_64_bits(spark):
    """Products of the score pass 64 bits where the counts are large."""
    docs = spark.createDataFrame([("en", "a b . " * 200_000)] * 12, "lang string, text string")
    assert [tuple(r) for r in collocations(docs).collect()] == [("en", 1, "a b", 2_400_000, 2_400_000, 2_400_000, 4_800_000, 2000)]


def test_words_that_share_a_hash(spark, monkeypatch):
    """Words that share a hash are found, and all is done again with the next seed."""
    docs = spark.createDataFrame([("en", "one two three. four five six. " * 20)], "lang string, text string")
    real, seeds = phrases._windows, []

    def clashing(texts, longest, least, seed):
        seeds.append(seed)
        rows = real(texts, longest, least, seed)
        return rows.withColumn("w1", F.lit(7).cast("long")) if seed == 0 else rows

    want = sorted(map(tuple, collocations(docs, least=5).collect()))
    monkeypatch.setattr(phrases, "_windows", clashing)
    assert sorted(map(tuple, collocations(docs, least=5).collect())) == want and len(want) == 2 and seeds == [0, 1]


def test_slices_of_batches(rows):
    """Words do not depend on where a batch is cut."""
    texts = pa.array([t or "" for _, t in rows])
    langs = pa.array([g or "und" for g, _ in rows])

    def spelled(w: Words) -> list:
        return [(w.langs[g].as_py(), w.names[c].as_py().decode(), bool(s)) for g, c, s in zip(w.lang, w.codes, w.same, strict=True)]

    whole = spelled(Words(langs, texts, 0))
    cut = [x for i in range(0, len(texts), 37) for x in spelled(Words(langs.slice(i, 37), texts.slice(i, 37), 0))]
    assert whole == cut and len(whole) > 5000
