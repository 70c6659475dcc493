"""BPE encoding and decoding with a contiguous rank array.

A word is its list of symbol ids and, beside it, the list of ranks of adjacent pairs. The smallest
rank is found by scanning, its boundary is deleted and the two neighbouring ranks are refreshed.
Words are short, so a scan is cheaper than a heap; words above ``LONG`` symbols use a heap over
linked boundaries, with the same result. Ids, their text and decoded text are kept per distinct
word, since a corpus repeats its words.

Normalisation and the classes of letters and numbers are those of the tokenizers library, whose version
of Unicode decides; splitting, merging and decoding are done here.

The vocabulary file is a parameter. The driver reads it and broadcasts its text: its size is that
of the vocabulary, not of the data.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from tokenizers import Regex
from tokenizers.normalizers import NFC, Lowercase, Sequence
from tokenizers.pre_tokenizers import Split

from tidemark.llm.common import id_and_text

#: Symbols of a word above which a heap finds the smallest rank.
LONG = 200
#: Distinct words kept in a worker, in each of two generations: below two thirds of 2^19, up to which a dict has
#: half the memory.
KEPT_WORDS = 345_000
_NO_RANK = 1 << 60
#: For texts up to U+017F: letters, numbers and white space as classes.
_LATIN = {"L": r"a-zA-Zªµºß-öø-ÿÀ-ÖØ-ÞĀ-ſ", "N": r"0-9²³¹¼½¾", "s": r"\t-\r\x20\x85\xa0"}
_COMMON_END = r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BEYOND_LATIN = re.compile(r"[^\x00-ſ]")


@cache
def _class(pattern: str) -> str:
    """The code points that a class holds for the tokenizers library, as ranges. Which letters and numbers
    there are depends on a version of Unicode; this is the library's, whatever Python's own is. A quarter of
    a plane at a time takes little memory."""
    split, found = Split(Regex(f"{pattern}+"), "removed", invert=True), []
    for start in range(0, 0x110000, 0x4000):
        part = "".join(chr(c) for c in range(start, start + 0x4000) if not 0xD800 <= c < 0xE000)
        found += [f"\\U{ord(run[0]):08x}-\\U{ord(run[-1]):08x}" for run, _ in split.pre_tokenize_str(part)]
    return "".join(found)


def unicode_classes() -> dict[str, str]:
    """Letters, numbers and white space over the whole code space, found once per process: the driver ships
    them to the workers."""
    return {"L": _class(r"\p{L}"), "N": _class(r"\p{N}"), "s": _class(r"\s")}


def _compiled(pattern: str, classes: dict[str, str]) -> re.Pattern[str]:
    for name in ("L", "N"):
        pattern = pattern.replace(rf"[\p{{{name}}}]", f"[{classes[name]}]").replace(rf"\p{{{name}}}", classes[name])
    return re.compile(pattern.replace(r"\s", classes["s"]))


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(0x100 + others.index(b)) for b in range(256)]


class WordBpe:
    """BPE with word ends over bytes, as the file describes it. Raises ValueError for a file with
    another kind of normaliser, splitter or model."""

    def __init__(self, description: str, classes: dict[str, str] | None = None) -> None:
        spec = json.loads(description)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"not a lower-casing BPE with word ends: {kinds}")
        self.end: str = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens: dict[int, str] = {i: t for t, i in self.vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.letters = _byte_letters()
        # of each byte within a word and at its end; None if the vocabulary lacks it
        self.inner = [self.vocab.get(x) for x in self.letters]
        self.last = [self.vocab.get(x + self.end) for x in self.letters]
        self.ranks: dict[int, int] = {}  # by first id * 2^20 + second id
        self.made: list[int] = []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[self.vocab[a] << 20 | self.vocab[b]] = len(self.made)
            self.made.append(self.vocab[a + b])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pattern = split["pattern"]["Regex"]
        if pattern.endswith(_COMMON_END) and all(x.startswith("'") for x in pattern.removesuffix(_COMMON_END).split("|") if x):
            # no two of these alternatives start alike but those with an apostrophe: letters go first
            pattern = r"[\p{L}]+|" + pattern.replace(r"|[\p{L}]+|", "|", 1)
        self.latin_words = _compiled(pattern, _LATIN)
        self.all_words = _compiled(pattern, classes or unicode_classes())
        # the library's tables of composition and of lower case, for texts beyond Latin
        self.normal = Sequence([NFC(), Lowercase()])

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii() or not _BEYOND_LATIN.search(text):  # what is up to U+017F is composed already
            return self.latin_words.findall(text.lower())
        return self.all_words.findall(self.normal.normalize_str(text))

    def segments(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """(id, []) for a special token in the text, (None, words) for what stands between."""
        if self.at_special is None or "<|" not in text:
            yield None, self.split(text)
            return
        for i, part in enumerate(self.at_special.split(text)):
            if i % 2:
                yield self.special[part], []
            elif part:
                yield None, self.split(part)

    def word(self, word: str) -> list[int]:
        """The ids of one word."""
        data = word.encode("utf-8", "surrogatepass")
        ids = [*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]]
        if None in ids:
            ids = [i for i in ids if i is not None]
        return self._long(ids) if len(ids) > LONG else self._short(ids)

    def _short(self, ids: list[int]) -> list[int]:
        rank = self.ranks.get
        ranks = [rank(a << 20 | b, _NO_RANK) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) != _NO_RANK:
            i = ranks.index(least)
            ids[i] = new = self.made[least]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(new << 20 | ids[i + 1], _NO_RANK)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | new, _NO_RANK)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.ranks.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[r], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (s := rank(ids[k] << 20 | ids[after[k]])) is not None:
                    heapq.heappush(heap, (s, k, ids[k], ids[after[k]]))
        return [x for x in ids if x is not None]

    def encode(self, text: str) -> list[int]:
        return [i for special, words in self.segments(text) for i in ([special] if special is not None else [x for w in words for x in self.word(w)])]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


class PerWord(dict):
    """What ``make`` gives for a word, kept for as many words as a worker may hold: when a generation
    is full it becomes the old one, from which words that come again move to the new."""

    def __init__(self, make: Callable[[str], object]) -> None:
        super().__init__()
        self.make = make
        self.old: dict[str, object] = {}

    def __missing__(self, word: str) -> object:
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
            if len(word) > LONG:
                return value
        if len(self) >= KEPT_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


_LOADED: dict[int, WordBpe] = {}
_KEPT: dict[tuple[int, str], PerWord] = {}


def loaded(shipped: tuple[str, dict[str, str]]) -> WordBpe:
    """The tokenizer of what ``ship`` gives, built once per worker."""
    if (key := hash(shipped[0])) not in _LOADED:
        _LOADED[key] = WordBpe(*shipped)
    return _LOADED[key]


def kept(bpe: WordBpe, kind: str, make: Callable[[str], object]) -> PerWord:
    return _KEPT.setdefault((id(bpe), kind), PerWord(make))


def read_description(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def ship(docs: DataFrame, vocabulary: str) -> Broadcast[tuple[str, dict[str, str]]]:
    """The vocabulary file and the classes of characters, for the workers: a few megabytes, whatever the data."""
    return docs.sparkSession.sparkContext.broadcast((read_description(vocabulary), unicode_classes()))


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256.

    Whole texts are encoded; null is empty, and an empty text has no tokens and the digests of the
    empty string. Strings of special tokens in a text are those tokens. Rows are independent:
    repeats give repeats, an empty table gives none, other columns are ignored. No shuffle.
    """
    shared = ship(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)

        def both(word: str) -> tuple[str, str]:
            ids = bpe.word(word)
            return " ".join(map(str, ids)), bpe.decode(ids)

        of = kept(bpe, "round trip", both).__getitem__
        for batch in batches:
            out: list[tuple[int, str, str]] = []
            for text in batch.column(1):
                ids, tokens = [], []
                for special, words in bpe.segments(text.as_py()):
                    if special is not None:
                        ids.append(str(special))
                        tokens.append(bpe.tokens[special])
                    elif words:
                        a, b = zip(*map(of, words), strict=True)
                        ids += a
                        tokens += b
                line = " ".join(filter(None, ids))
                decoded = " ".join(filter(None, tokens))
                out.append((line.count(" ") + 1 if line else 0, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            n, a, b = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
