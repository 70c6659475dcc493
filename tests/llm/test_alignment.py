"""Alignment of tokenizers against whole-text encoding and plain counting."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment
from tidemark.llm.alignment import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = {c: b for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]), strict=True)}
LETTERS |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in LETTERS.values())}


def plain(rows: list[tuple]) -> list[tuple]:
    """The contract, text by text and byte by byte."""
    a_of, b_of = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_of.encode_special_tokens = True
    aligned, held = [], Counter()
    for _, text in rows:
        links, groups, n = Counter(), [], (0, 0)
        if text:
            whole, found = f" {text}".encode(), {}
            a, b = a_of.encode(f" {text}", add_special_tokens=False), b_of.encode(text)
            a_bytes = [bytes(LETTERS[c] for c in t) for t in a.tokens]
            b_bytes = [bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
            if b"".join(a_bytes) == whole == b"".join(b_bytes):
                n = len(a), len(b)
                sides = [[k for k, x in enumerate(tokens) for _ in x] for tokens in (a_bytes, b_bytes)]
                links.update((a.ids[i], b[j]) for i, j in set(zip(*sides, strict=True)))
                ends = [{e for e in range(1, len(whole) + 1) if e == len(whole) or side[e] != side[e - 1]} for side in sides]
                start = 0
                for e in sorted(ends[0] & ends[1]):
                    ids = [list(dict.fromkeys(side[start:e])) for side in sides]
                    groups.append(",".join(str(a.ids[i]) for i in ids[0]) + "|" + ",".join(str(b[j]) for j in ids[1]))
                    start = e
        held.update(links.keys())
        aligned.append((n, links, groups))
    most = defaultdict(int)
    for (a, _), f in held.items():
        most[a] = max(most[a], f)
    out = []
    for (key, _), (n, links, groups) in zip(rows, aligned, strict=True):
        best = sum(m for (a, b), m in links.items() if held[a, b] == most[a])
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((key, *n, len(groups), sum(links.values()), best, sum(m * held[p] for p, m in links.items()), digest))
    return sorted(out, key=str)


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\nb c", "\n", "\t x \u00a0y", "don't we'll I'M", "<|endoftext|> and </s> <s> <0x41> <unk>", "\u2581a", "a\u2581b c",
    "\u65e5\u672c\u8a9e \U0001f600\U0001f468\u200d\U0001f469 caf\u00e9 cafe\u0301", "\x00 \x01a", "x" * 5000, " " * 300, "a b " * 3000, "1234 5678.90", "\ufeffx \ufffd", "\u3000a \u2028 b\u0085c \x1c d",
]


@pytest.mark.parametrize("fan", [128, 2])
def test_against_plain_counting(spark, sf_dir, monkeypatch, fan):
    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()[:90]
    dice = random.Random(4)
    odd = ["".join(dice.choice(" \n\tab,.\u00e9\u65e5\u0301'1\u2003\U0001f600") for _ in range(dice.randrange(60))) for _ in range(150)]
    rows = [(i % 250, t) for i, t in enumerate([*ODD, *texts, *odd, *["same text again"] * 90])] + [(None, "same text again")]
    if fan == 2:  # many runs, in several rounds of merges, and a cache that is emptied
        monkeypatch.setattr(alignment, "RUN_DOCS", 13)
        monkeypatch.setattr(alignment, "KEPT", 50)
    docs = spark.createDataFrame([(i, t, 1, 2, "x", b"y") for i, t in rows], "doc_id long, text string, part int, node int, run string, pairs binary").repartition(3)
    got = sorted((tuple(r) for r in align(docs, A, B, fan=fan).collect()), key=str)
    assert got == plain(rows)


def test_no_tokens_at_all(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "\u2581")], "doc_id long, text string")
    assert sorted(tuple(r) for r in align(docs, A, B).collect()) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]
    assert align(docs.where("doc_id = 9"), A, B).isEmpty()


def test_other_kinds_of_vocabulary_are_refused(tmp_path):
    spec = json.loads(alignment.read_description(A)) | {"normalizer": {"type": "NFC"}}
    with open(B, "rb") as f, pytest.raises(ValueError, match="cut"):
        alignment.Segments(json.dumps(spec), f.read())
