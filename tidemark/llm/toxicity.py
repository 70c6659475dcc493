"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Texts are folded first: compatibility forms, lower case, homoglyphs to the letters they look like,
digits and signs inside words to the letters they stand for, anything else to one space. Terms are
words or beginnings of words. Their weights are learned from labelled rows: a Spark job counts, per
candidate term, the toxic and other texts that have it and in how many different contexts (sketched
as bits, so that many near copies of one text count once), and keeps terms whose log-odds are high
even at the low end of their uncertainty and no work of chance. Phrases that contain a term but come with the other label
are learned in the same way and cancel the term's hit. Weights of hits are summed and divided by a
slowly growing function of the length; a logistic curve over that sum, fitted on the same rows,
is the score.

Labelled rows learned from are bounded by ``MOST``. Terms, phrases and points of the curve that go through
the driver come from these rows alone, and are bounded with them; none is left out.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, id_and_text
from tidemark.llm.labelled import remainder, sample

#: Labelled rows learned from, at most (in expectation).
MOST = 20_000
THRESHOLD = 0.3
#: Beginnings of words that are candidate terms have these lengths.
STEMS = range(4, 9)
#: Of a term: least different toxic contexts, least log-odds at the low end of their uncertainty,
#: and least evidence against chance (the exponent of the binomial tail; many terms are tried).
CONTEXTS, ODDS, EVIDENCE = 3, 1.0, 11.0
#: Bits of a sketch of contexts, and texts without the other label that make a phrase an exception.
BITS, HARMLESS = 63, 3
#: Texts of up to this many words are not normalised by length.
SHORT = 200

#: Letters that look like Latin ones, and signs that stand for letters in words.
HOMOGLYPHS = {
    **dict(zip("аеорсухіјѕһԁԛԝѵɡ", "aeopcyxijshdqwvg", strict=True)),
    **dict(zip("вкмнтьгп", "bkmhtbrn", strict=True)),
    **dict(zip("αβγεηικνορτυχωσ", "abyenikvoptuxwo", strict=True)),
    **dict(zip("ıłøđħŧ", "ilodht", strict=True)),
}
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
_FOLD = str.maketrans(HOMOGLYPHS | {c: "" for c in "​‌‍⁠﻿­"})
_LEET = str.maketrans(LEET)
_SIGNS = "0123456789@$!|"
#: A digit or sign before a letter, and what may follow it up to the end of its word.
_TURN = re.compile(r"[0-9@$!|](?=[^\W\d_])")
_TAIL = re.compile(r"(?:[@$!|]*+\w)*+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?![^\W_])")
_OTHER = re.compile(r"[\W_]+")


def _undisguised(text: str) -> str:
    """Digits and signs of a word for the letters that they stand for, if a letter follows one of them. Of a word
    of letters, digits and signs, what stands before the signs at its first such place counts, and all that
    follows up to the last letter or digit; each character is visited a few times at most."""
    parts, done = [], 0
    for turn in _TURN.finditer(text):
        if (start := turn.end()) <= done:
            continue  # in a word that has been dealt with
        while start > done and text[start - 1] in _SIGNS:
            start -= 1
        while start > done and text[start - 1].isalnum():
            start -= 1
        end = _TAIL.match(text, turn.end()).end()
        parts += [text[done:start], text[start:end].translate(_LEET)]
        done = end
    return "".join([*parts, text[done:]]) if parts else text


def fold(text: str) -> str:
    """The text as words of plain letters with one space around each."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    if not text.isalpha():
        text = _SPACED.sub(lambda m: re.sub(r"[ .*_-]", "", m[0]), text)
        # digits and signs stand for letters only where a letter follows
        text = _undisguised(text)
    return f" {_OTHER.sub(' ', text).strip()} "


def candidates(words: list[str], i: int) -> list[str]:
    """Terms that match at word i: the word, and its beginnings."""
    w = words[i]
    return [f" {w} ", *(f" {w[:n]}" for n in STEMS if n < len(w))]


@dataclass
class Lexicon:
    terms: dict[str, float]
    #: Phrases that cancel the hits within them.
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.0
    centre: float = 1.0

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(term, (len(term), weight, term))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), 0.0, phrase))
        if not len(found):
            return None
        found.make_automaton()
        return found


def hits(folded: str, automaton: ahocorasick.Automaton | None) -> list[tuple[int, int, float, str]]:
    """(start, end, weight, term) of hits outside exceptions; of hits that start at one word, the
    heaviest."""
    if automaton is None:
        return []
    best: dict[int, tuple[int, int, float, str]] = {}
    exempt: list[tuple[int, int]] = []
    for end, (n, weight, term) in automaton.iter(folded):
        start = end - n + 1
        if not weight:
            exempt.append((start, end + 1))
        elif start not in best or best[start][2] < weight:
            best[start] = (start, end + 1, weight, term)
    # a hit is exempt if an exception that starts no later reaches as far as it does
    exempt.sort()
    starts, reach = [a for a, _ in exempt], [*accumulate((b for _, b in exempt), max)]
    return [h for h in best.values() if not (k := bisect_right(starts, h[0])) or reach[k - 1] < h[1]]


def raw_score(folded: str, automaton: ahocorasick.Automaton | None) -> float:
    """Summed weights, normalised by length: a text of n words counts as max(1, log2(2n / SHORT))."""
    total = sum(h[2] for h in hits(folded, automaton))
    return total / max(1.0, float(np.log2(2 * (folded.count(" ") - 1) / SHORT))) if total else 0.0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per candidate term of these texts: toxic and other texts with it, and contexts as bits."""
    seen: dict[str, list[int]] = {}
    for batch in batches:
        for text, y in zip(batch.column(0), batch.column(1), strict=True):
            words = fold(text.as_py()).split()
            had: set[str] = set()
            for i, w in enumerate(words):
                bit = 1 << (zlib.crc32(" ".join([*words[max(0, i - 1) : i], "_", *words[i + 1 : i + 2]]).encode()) % BITS)
                for term in candidates(words, i):
                    x = seen.setdefault(term, [0, 0, 0, 0])
                    x[2 + (not y.as_py())] |= bit
                    if term not in had:
                        had.add(term)
                        x[not y.as_py()] += 1
    for at in range(0, len(keys := list(seen)), 50_000):
        part = keys[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part)] + [pa.array([seen[k][j] for k in part], pa.int64()) for j in range(4)], names=["term", "bad", "good", "bad_in", "good_in"])


def _contexts(texts: str, bits: str) -> Column:
    """Different contexts by linear counting of the sketch's bits, of which there are no more than texts;
    the texts themselves where the sketch is full."""
    free = F.greatest(1 - F.col(bits) / BITS, F.lit(0.5 / BITS))
    return F.when(F.col(bits) == BITS, F.col(texts).cast("double")).otherwise(F.least(F.col(texts).cast("double"), -BITS * F.log(free)))


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Lexicon:
    """Learns from labelled rows whose crc32 of the id, modulo 4, is not 2. Without labels of both
    kinds the lexicon is empty and every score is that of a text without hits."""
    known = durable(sample(docs, labels, "toxic", remainder(4) != 2, most).select("text", "y"))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return Lexicon({})
    counts = known.mapInArrow(_counted, "term string, bad long, good long, bad_in long, good_in long").groupBy("term").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.bit_count(F.bit_or("bad_in")).alias("bad_in"), F.bit_count(F.bit_or("good_in")).alias("good_in")
    )
    b, g = (_contexts(texts, bits) + 0.5 for texts, bits in (("bad", "bad_in"), ("good", "good_in")))
    odds = F.log(b / (bad + 1)) - F.log(g / (good + 1)) - F.sqrt(1 / b + 1 / g)
    share = F.lit(bad / (bad + good))
    evidence = (b - 0.5) * F.log(b / (b + g) / share) + (g - 0.5) * F.log(g / (b + g) / (1 - share))
    ranked = counts.where((F.col("bad_in") >= CONTEXTS) & (evidence >= EVIDENCE)).withColumn("weight", odds).where(F.col("weight") > ODDS)
    rows = ranked.collect()
    terms: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r.term), r.term)):
        # a longer term adds nothing to a beginning of it that weighs as much
        if not any(terms.get(r.term[:k], -1.0) >= r.weight * 0.9 for k in range(2, len(r.term))):
            terms[r.term] = float(r.weight)
    lexicon = Lexicon(terms)
    lexicon.exceptions = _exceptions(known, terms)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([raw_score(fold(t.as_py()), automaton) for t in batch.column(0)], pa.float64()), batch.column(1)], names=["raw", "y"])

    points = known.mapInArrow(raw, "raw double, y int").collect()
    lexicon.slope, lexicon.centre = _curve(np.array([p.raw for p in points]), np.array([p.y for p in points]))
    return lexicon


def _exceptions(known: DataFrame, terms: dict[str, float], least: int = HARMLESS) -> list[str]:
    """Phrases of a term with the word before or after it that come in ``least`` texts or more of
    label 0 and in none of label 1."""
    shared = known.sparkSession.sparkContext.broadcast(Lexicon(terms))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in batches:
            out: list[tuple[str, int]] = []
            for text, y in zip(batch.column(0), batch.column(1), strict=True):
                folded = fold(text.as_py())
                found: set[str] = set()
                for start, end, _, _ in hits(folded, automaton):
                    stop = folded.index(" ", max(start + 1, end - 1)) + 1
                    before = folded.rfind(" ", 0, start) if start else -1
                    after = folded.find(" ", stop)
                    found |= {folded[before:stop]} if before >= 0 else set()
                    found |= {folded[start : after + 1]} if after >= 0 else set()
                out += [(p, y.as_py()) for p in found]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([y for _, y in out], pa.int32())], names=["phrase", "y"])

    counts = known.mapInArrow(phrases, "phrase string, y int").groupBy("phrase").agg(F.count("*").alias("n"), F.max("y").alias("bad"))
    return sorted(r.phrase for r in counts.where((F.col("bad") == 0) & (F.col("n") >= least)).select("phrase").collect())


def _curve(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, centre) of the logistic curve, centred where telling labels apart by the sum alone
    gives the best mean of both labels' accuracies, halfway between the sums around that place."""
    values, at = np.unique(raw, return_inverse=True)
    ones = np.bincount(at, y == 1, len(values))
    zeros = np.bincount(at, y == 0, len(values))
    # told toxic: sums of values[k] and above, for k from 1
    right = (ones.sum() - np.cumsum(ones)[:-1]) / max(ones.sum(), 1) + np.cumsum(zeros)[:-1] / max(zeros.sum(), 1)
    if not right.size:
        return 1.0, float(values[0]) + 1.0
    k = int(right.argmax())
    gap = float(values[k + 1] - values[k])
    return 8.0 / max(gap, 0.25), float(values[k] + gap / 2)


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, n_hits.

    Null and empty texts have no hits; repeats give repeats, an empty table gives none; only the
    text is used, other columns are ignored. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        automaton = lexicon.automaton()
        for batch in batches:
            raw, n = [], []
            for text in batch.column(1):
                folded = fold(text.as_py())
                raw.append(raw_score(folded, automaton))
                n.append(len(hits(folded, automaton)) if raw[-1] else 0)
            z = lexicon.slope * (np.array(raw, np.float64) - lexicon.centre)
            s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(n, pa.int32())],
                names=["doc_id", "held_out", "score", "predicted", "n_hits"],
            )

    rows = id_and_text(docs).withColumn("held_out", remainder(4) == 2)
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_hits int")


def toxicity_scores(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """``score`` by a lexicon that is learned from labelled rows of ``docs`` (``most`` in expectation). Labels that
    are null or not 0 or 1 are left out, as are those without an id; without both labels every
    score is that of a text without hits."""
    return score(docs, learn(docs, labels, most))
