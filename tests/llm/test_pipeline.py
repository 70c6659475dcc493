from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_dedup import classes, shingle_set
from tidemark.llm import exact, minhash, quality, secrets


def test_stages(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == names and 0 < docs.count() <= before, name
        before = docs.count()
    # redaction may make texts alike again, so duplicates are looked for before it
    near = spark.read.parquet(f"{tmp_path}/2")
    assert exact.exact_groups(near).where("NOT kept").isEmpty()
    assert minhash.near_duplicates(near).where("NOT kept").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert packed.select("doc_id").distinct().count() == docs.count()
    # clean documents stay: of those marked good, nearly all that have no copy are there
    labels = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1")
    first = spark.read.parquet(f"{tmp_path}/0")
    assert first.join(labels, "doc_id", "left_semi").count() >= 0.99 * labels.count()


def test_near_copies_from_080_on(spark, make_docs):
    def text(k, n, changed):
        words = [f"w{k}x{i}" for i in range(n)]
        words[-1:] = [f"n{i}" for i in range(changed)] or words[-1:]
        return " ".join(words)

    # the last word becomes c others: n - 5 of the n - 4 + c shingles are shared
    texts, want = [], set()
    for k, (n, changed) in enumerate([(64, 9), (104, 19), (104, 23), (104, 24), (304, 55), (304, 73), (304, 75)]):
        a, b = (set(minhash.shingles(t).tolist()) for t in (text(k, n, 0), text(k, n, changed)))
        similarity = len(a & b) / len(a | b)
        texts += [text(k, n, 0), text(k, n, changed)]
        want |= {2 * k} if similarity >= 0.8 else {2 * k, 2 * k + 1}
        if k in (1, 2, 4, 5):
            assert 0.8 <= similarity < 0.85
    got = corpus_pipeline.near_dedup(spark, make_docs(texts), "")
    assert {r.doc_id for r in got.collect()} == want


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, t, lang in rows], "doc_id long, text string, lang string").repartition(3)


def test_exact_dedup_decides_on_rows(spark):
    rows = [(3, "same text", "a"), (7, "unique text", "b"), (7, "same  text", "c"), (7, "sametext", "d"), (9, "twice", "e"), (9, "twice", "e"), (9, "twice", "f")]
    rows += [(None, "with an id", "g"), (12, "with an id", "h"), (None, "no id", "i"), (None, "no id", "i"), (None, None, "j"), (14, "", "k"), (14, " ", "l"), (None, "alone", "m")]
    out = corpus_pipeline.exact_dedup(spark, rows_of(spark, rows), "")
    assert out.columns == ["doc_id", "text", "lang"]
    got = sorted((str(r.doc_id), r.text) for r in out.collect())
    assert got == sorted([("7", "same  text"), ("7", "unique text"), ("9", "twice"), ("12", "with an id"), ("None", "no id"), ("14", " "), ("None", "alone")])


def test_near_dedup_decides_on_rows(spark):
    def text(name, end):
        return " ".join([f"{name}{i}" for i in range(60)] + [end])

    rows = [(3, text("a", "x"), "a"), (7, text("b", "x"), "b"), (7, text("a", "y"), "c"), (5, text("c", "x"), "d"), (5, text("c", "x"), "d"), (5, text("c", "y"), "e")]
    rows += [(None, text("d", "x"), "f"), (20, text("d", "y"), "g"), (None, text("e", "x"), "h"), (None, text("e", "y"), "h"), (None, None, "i"), (8, "", "j"), (None, text("f", "x"), "k")]
    out = corpus_pipeline.near_dedup(spark, rows_of(spark, rows), "")
    assert out.columns == ["doc_id", "text", "lang"]
    got = out.collect()
    assert sorted((str(r.doc_id), (r.text or "-")[0]) for r in got) == sorted([("3", "a"), ("7", "b"), ("5", "c"), ("20", "d"), ("None", "e"), ("None", "-"), ("8", "-"), ("None", "f")])


COLUMNS = "doc_id long, text string, lang string, _row int, row string, kept int, blob string, _kept int, component_id string, digest int, score double"


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Tables with near and exact copies, junk, secrets, nulls in any column, empty and very long texts, ties,
    repeated rows and ids, and columns named like what the stages use inside."""
    rng = random.Random(17)
    words = [f"{a}{b}" for a in ("lor", "ips", "dol", "am", "con", "sec", "ad") for b in ("em", "um", "or", "it", "ter", "tur", "ip")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.randrange(20, 120)) for _ in range(80)]
    for t in texts[:20]:  # near copies, some of them just below or above the threshold
        w = t.split()
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [t.replace(" ", "  ", 3) for t in texts[20:30]] + [f"{prose(30)} password = 'abcdefghijklmnop' {prose(5)} AKIAABCDEFGHIJKLMN0" for _ in range(5)]
    texts += [" ".join([rng.choice(words)] * rng.randrange(20, 200)) for _ in range(40)]  # junk
    texts += [prose(20_000), "x" * 50_000, None, None, "", "  \t", "token=token=abcdefghijklmnopqrst", "-----BEGIN RSA PRIVATE KEY-----"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[50]), (3, texts[3]), (None, texts[51]), (None, texts[51]), (None, "nobody's own text, " + prose(30)), (60, prose(40)), (60, texts[60])]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(i, t, rng.choice(["en", None]), rng.choice([1, None]), "r", None, "b", 0, "c", None, 0.5) for i, t in rows], COLUMNS)
    d = str(tmp_path_factory.mktemp("odd"))
    frame.repartition(5).write.parquet(f"{d}/documents.parquet")
    junk = {i for i, t in enumerate(texts) if t and len(set(t.split())) == 1 and len(t.split()) > 1}
    spark.createDataFrame([(i, int(i not in junk)) for i in range(len(texts)) if texts[i]] + [(None, 1), (5, None)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    return d


def plain_quality(rows, model):
    weights, bias = model
    out = []
    for r in rows:
        w = (r["text"] or "").split()
        f = [x for word in w for x in quality.word_features(word)]
        for a, b in zip(w, w[1:], strict=False):
            f += quality.pair_features(np.array([quality.word_hash(a), quality.word_hash(b)], np.uint64))[0].tolist() + [quality.PATTERNS + (a == b)] * quality.PATTERN_COUNT
        z = bias + weights[f].astype(np.float64).sum() / (len(f) + quality.PRIOR) if w else bias
        out += [r] if 1 / (1 + math.exp(-z)) >= 0.3 else []
    return out


def last(i):
    return (i is None, i or 0)


def plain_exact(rows):
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), []).append(r)
    return [min(g, key=lambda r: (-len(r["text"] or ""), last(r["doc_id"]))) for g in groups.values()]


def plain_near(rows):
    sets = [shingle_set(r["text"]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    of: dict[int, list] = {}
    for r, c in zip(rows, classes(len(rows), links), strict=True):
        of.setdefault(c, []).append(r)
    return [min(g, key=lambda r: last(r["doc_id"])) for g in of.values()]


def plain_redaction(rows):
    out = []
    for r in rows:
        text = r["text"] or ""
        spans = sorted(m.span() for rule in secrets.RULES for m in re.finditer(rule.pattern, text) if len(m.group(rule.group)) >= rule.least)
        parts, at = [], 0
        for a, b in spans:
            if a >= at:
                parts += [text[at:a], "[SECRET]"]
            at = max(at, b)
        out.append(r | {"text": "".join(parts) + text[at:] if spans else r["text"]})
    return out


def texts_of(rows):
    """What a stage decided: ids and texts (which of equal rows stays is open)."""
    return sorted((str(r["doc_id"]), str(r["text"])) for r in rows)


def test_each_stage_against_a_plain_version(spark, odd_dir, tmp_path):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{odd_dir}/labels.parquet"))
    plain = [lambda rows: plain_quality(rows, model), plain_exact, plain_near, plain_redaction]
    names, shrinks = docs.columns, []
    for k, ((name, stage), by_hand) in enumerate(zip(corpus_pipeline.STAGES[:-1], plain, strict=True)):
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, odd_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = [r.asDict() for r in docs.collect()]
        assert docs.columns == names and texts_of(after) == texts_of(by_hand(before)), name
        shrinks.append(len(before) - len(after))
        # every row is one of the rows before, with all its columns
        ids = {tuple(v for c, v in r.items() if c != "text") for r in before}
        assert all(tuple(v for c, v in r.items() if c != "text") in ids for r in after)
    assert shrinks[0] >= 30 and shrinks[1] >= 10 and shrinks[2] >= 5 and shrinks[3] == 0
    assert sum("[SECRET]" in (r.text or "") for r in docs.collect()) >= 5
    theirs = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    theirs.no_padding(), theirs.no_truncation()
    lengths = sorted((str(r.doc_id), len(theirs.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    ends: dict[int, int] = {}
    for r in corpus_pipeline.run(spark, odd_dir).orderBy("sequence_id", "offset").collect():
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and sum(ends.values()) == sum(n for _, n in lengths)
    want: Counter[str] = Counter()
    for i, n in lengths:
        want[i] += n
    assert {str(r[0]): r[1] for r in corpus_pipeline.run(spark, odd_dir).groupBy("doc_id").sum("length").collect()} == want


def test_an_empty_table_goes_through(spark, odd_dir):
    none = spark.read.parquet(f"{odd_dir}/documents.parquet").where("_kept < 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, odd_dir).isEmpty(), name


def test_numbers_of_rows(spark, odd_dir):
    """By file and place for whole tables, by a copy for anything else; unique, and the same when read again."""
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    for frame, copied in ((docs, False), (docs.sample(0.5, 1), True), (docs.where("doc_id > 5"), True), (docs.unionByName(docs), True), (docs.join(spark.range(2), how="cross"), True), (docs.withColumn("_metadata", docs["lang"]), False)):
        rows, row = corpus_pipeline._numbered(spark, frame)
        numbers = sorted(map(str, rows.select(row, "doc_id", "text").collect()))
        assert rows.select(row).distinct().count() == len(numbers) == frame.count()
        assert sorted(map(str, rows.select(row, "doc_id", "text").repartition(2).collect())) == numbers
        assert ("documents.parquet" not in rows.inputFiles()[0]) == copied
