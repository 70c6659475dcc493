from __future__ import annotations

import hashlib
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t, bpe.WordBpe(bpe.read_description(PATH))


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=40))
def test_any_text(both, text):
    theirs, ours = both
    e = theirs.encode(text, add_special_tokens=False).ids
    assert ours.encode(text) == e
    assert ours.decode(e) == theirs.decode(e, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["it's WE'LL i'D", "a<|endoftext|>B<|startoftext|> c", "<|ENDOFTEXT|>", "x" * 5000, "ab" * 700 + "é" * 900, "ὈΔΥΣΣΕΎΣ", "é", "½²Ⅷ٣", ""])
def test_cases(both, text):
    theirs, ours = both
    assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_every_code_point(both):
    """All of planes 0 to 3 and 14, among them what is not assigned, and every 61st of the others."""
    theirs, ours = both
    points = [*range(0xD800), *range(0xE000, 0x40000), *range(0x40000, 0xE0000, 61), *range(0xE0000, 0xE1000), *range(0xE1000, 0x110000, 61)]
    for at in range(0, len(points), 50_000):
        texts = [f"a{chr(c)}B" for c in points[at : at + 50_000]]
        for text, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
            assert ours.encode(text) == e.ids, hex(ord(text[1]))


def test_marks_are_put_in_the_library_s_order(both):
    theirs, ours = both
    rng = random.Random(4)
    marks = [c for c in range(0x300, 0x20000) if unicodedata.category(chr(c)).startswith("M")] + [0x1DFA, 0x1ACA]
    texts = ["".join(chr(rng.choice(marks)) if rng.random() < 0.7 else rng.choice("aeoAEkΣσ가각क") for _ in range(6)) for _ in range(20_000)]
    for text, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ours.encode(text) == e.ids, ascii(text)


def test_long_words_give_what_short_ones_do(both):
    _, ours = both
    for word in ("therein" * 60, "aaaa" * 80, "xyzzy" * 50):
        letters = [ours.letters[b] for b in word.encode()]
        letters[-1] += ours.end
        ids = [ours.vocab[x] for x in letters]
        assert ours._long(list(ids)) == ours._short(list(ids))


def test_round_trip(spark, make_docs, odd_texts, both):
    theirs, _ = both
    got = {r.doc_id: r for r in bpe.round_trip(make_docs(odd_texts), PATH).collect()}
    assert len(got) == len(odd_texts)
    for i, text in enumerate(odd_texts):
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        decoded = theirs.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.round_trip(make_docs(["x"]).where("doc_id < 0"), PATH).count() == 0


def test_packing(spark, make_docs, odd_texts, both):
    theirs, _ = both
    texts = odd_texts + [" ".join(["word"] * (i * 37 % 900)) for i in range(300)]
    for per, capacity in ((100_000, 4096), (60, 512)):
        seen: list[dict] = []
        rows = packing.pack(make_docs(texts), PATH, capacity=capacity, per_partition=per, certificates=seen).collect()
        lengths: dict[int, int] = {}
        bins: dict[int, list] = {}
        encoded = {i: np.array([*theirs.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(encoded[r.doc_id][r.start : r.start + r.length].tobytes())
            lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
            assert r.start == r.piece * capacity and 0 < r.length <= capacity
        assert lengths == {i: len(theirs.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        whole = sum(1 for parts in bins.values() if parts[0][1] == capacity)
        assert len(bins) - whole == min(c["bins_in_all"] for c in seen)
        assert all(c["bound"] <= c["bins"] for c in seen) and (per == 60) == (len(seen) > 1)
        least = -(-sum(lengths.values()) // capacity)
        assert len(bins) <= least * 1.05 + 1
    assert packing.pack(make_docs(["x"]).where("doc_id < 0"), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_bounds_hold(lengths):
    x = np.array(lengths, np.int64)
    bins, offsets, left = packing.best_fit(x, 64)
    used = np.zeros(len(left), np.int64)
    np.add.at(used, bins, x)
    assert (used + left == 64).all() and packing.lower_bound(x, 64) <= len(left)
    assert len(left) <= 2 * max(1, packing.lower_bound(x, 64))
