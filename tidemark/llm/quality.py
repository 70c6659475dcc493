"""Quality classifier by supervised subword embeddings.

A document's features are its words, their character n-grams, its word pairs, and the patterns of its word
pairs (a pair with each word named by its first place in it, so that "x x" and "y y" are one feature),
hashed to buckets. Each bucket has a learned vector; a document is the mean of its features' vectors, and a softmax layer over that
mean gives the label's probability. Vectors and layer are trained by stochastic gradient descent in
numpy by one task, on a bounded sample of labelled rows (``most``), whose features are hashed by many.

The softmax of a mean is linear in the vectors, so scoring needs one number per bucket: a table of
``TABLE`` floats is all that is broadcast. Scores need no shuffle, and a word's sum is kept per
distinct word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.bpe import KEPT_WORDS, PerWord
from tidemark.llm.common import id_and_text
from tidemark.llm.labelled import remainder, sample

BUCKETS = 1 << 17
DIM = 10
NGRAMS = (3, 4)
#: Labelled rows learned from, at most (in expectation).
MOST = 4000
EPOCHS = 5
RATE = 0.5
THRESHOLD = 0.3
#: Features without weight that every text has beside its own, so that a few words decide little.
PRIOR = 100
#: Buckets of words and characters come first, then as many of word pairs, then those of patterns, of which
#: there are two. A pattern counts as so many features, as a word has about as many of its own.
PATTERNS, PATTERN_COUNT = 2 * BUCKETS, 8
TABLE = PATTERNS + 2
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Characters of a word whose n-grams are taken; a word beyond it is cut into pieces of this length.
WORD = 64


def word_features(word: str) -> list[int]:
    """Buckets of a word and of its n-grams, with marks for its ends."""
    out = []
    for at in range(0, len(word), WORD):
        part = f"<{word[at : at + WORD]}>"
        out.append(zlib.crc32(part.encode("utf-8", "surrogatepass")) % BUCKETS)
        for n in NGRAMS:
            out += [zlib.crc32(part[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS for i in range(len(part) - n + 1)]
    return out


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def pair_features(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's word pairs, and how many of them have each pattern, from the words' hashes."""
    first, second = hashes[:-1], hashes[1:]
    mixed = (first * _FIRST + second * _SECOND) >> np.uint64(40)
    same = int((first == second).sum())
    return BUCKETS + (mixed % np.uint64(BUCKETS)).astype(np.int32), np.array([len(first) - same, same])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, distinct buckets, their counts) of each text."""
    of = PerWord(lambda w: (word_hash(w), np.array(word_features(w), np.int32)))
    for batch in batches:
        rows = []
        for text in batch.column(0):
            words = [of[w] for w in text.as_py().split()]
            pairs, patterns = pair_features(np.array([h for h, _ in words], np.uint64))
            each = np.repeat(np.array([PATTERNS, PATTERNS + 1], np.int32), PATTERN_COUNT * patterns)
            rows.append(np.unique(np.concatenate([pairs, each, *(f for _, f in words)]), return_counts=True))
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array([b.astype("<i4").tobytes() for b, _ in rows], pa.binary()), pa.array([c.astype("<f4").tobytes() for _, c in rows], pa.binary())],
            names=["y", "buckets", "counts"],
        )


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 1) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias) of the log-odds of label 1, from (buckets, counts, label).

    Without examples of both labels, all weights are 0 and the bias is that of the labels seen
    (even odds for none).
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (TABLE, DIM))
    layer, bias = np.zeros((DIM, 2)), np.zeros(2)
    ys = Counter(y for *_, y in examples)
    if len(ys) < 2:
        return np.zeros(TABLE, np.float32), float(np.log((ys[1] + 1) / (ys[0] + 1)))
    steps, total = 0, EPOCHS * len(examples)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            buckets, counts, y = examples[i]
            rate = RATE * (1 - steps / total)
            steps += 1
            share = counts / (counts.sum() + PRIOR)
            mean = share @ vectors[buckets]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            # all features of a text share one gradient; scaled up, as a single bucket's share is small
            vectors[buckets] -= (rate * 10 * np.sqrt(share))[:, None] * back
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model, from all examples; their features stay in Arrow's buffers."""
    rows = []
    for batch in batches:
        for y, b, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            rows.append((np.frombuffer(b.as_buffer(), "<i4"), np.frombuffer(c.as_buffer(), "<f4"), y))
    rows.sort(key=lambda r: (r[2], r[0].tobytes(), r[1].tobytes()))
    weights, bias = train(rows)
    yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> tuple[np.ndarray, float]:
    """Learns from labelled rows whose crc32 of the id, modulo 5, is not 0. One task has the sample's features, which
    are bounded by ``most``; only the model reaches the driver."""
    examples = sample(docs, labels, "quality", remainder(5) != 0, most).mapInArrow(_features, "y int, buckets binary, counts binary")
    for r in examples.repartition(1).mapInArrow(_trained, "weights binary, bias double").collect():
        return np.frombuffer(r.weights, "<f4"), r.bias
    return train([])


def _scorer(model: tuple[np.ndarray, float]) -> Callable[[pa.Array], np.ndarray]:
    """Scores of an array of texts."""
    weights, bias = model

    words = _Scored(weights)

    def run(texts: pa.Array) -> np.ndarray:
        z = []
        for text in texts:
            sums, sizes, hashes = words.of((text.as_py() or "").split())
            if not len(sums):
                z.append(bias)
                continue
            pairs, patterns = pair_features(hashes)
            total = float(sums.sum()) + float(weights[pairs].sum()) + PATTERN_COUNT * float(weights[PATTERNS:] @ patterns)
            z.append(bias + total / (int(sizes.sum()) + len(pairs) + PATTERN_COUNT * len(pairs) + PRIOR))
        return 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -500, 500)))

    return run


class _Scored(dict):
    """The places of words in arrays of what scoring needs of them: sum of weights, number of features, hash. When
    as many words or characters are known as a worker may hold, all are forgotten before the next text."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights, self.characters = weights, 0
        self.sums, self.sizes, self.hashes = np.zeros(1024), np.zeros(1024, np.int64), np.zeros(1024, np.uint64)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.sums):
            self.sums, self.sizes, self.hashes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.sizes, self.hashes))
        f = word_features(word)
        self.sums[at], self.sizes[at], self.hashes[at] = self.weights[f].sum(dtype=np.float64), len(f), word_hash(word)
        self[word] = at
        self.characters += len(word)
        return at

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self) > KEPT_WORDS or self.characters > 20 * KEPT_WORDS:
            self.clear()
            self.characters = 0
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.sums[at], self.sizes[at], self.hashes[at]


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts have no features and get the model's bias; repeats give repeats, an empty
    table gives none; only the text is used, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared.value)
        for batch in batches:
            s = scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = id_and_text(docs).withColumn("held_out", remainder(5) == 0)
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(place)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """``score`` by a model that is learned from labelled rows of ``docs`` (``most`` in expectation). Labels that
    are null or not 0 or 1 are left out, as are those without an id; without both labels every
    score is that of the labels seen."""
    return score(docs, fit(docs, labels, most))
