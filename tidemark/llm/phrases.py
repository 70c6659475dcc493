"""Phrases whose words meet more often than chance, by marginalising counts of longest windows.

Each word of a piece leads a window of the words that follow it, padded at the piece's end: columns of
shifted words, no phrase is built. Only whole windows are counted; a ROLLUP over the columns sums them to
windows one word shorter, again and again, since the occurrences of a phrase are the windows that start
with it. Every length is counted by that one pass.

A window may end earlier than its piece without changing a count that matters: a phrase that is frequent
enough has only frequent word pairs in it. So pairs are counted first, by a hash of 48 bits, as sorted
runs that meet by hash range; a map of bits (16 MB, whatever the data) tells which are frequent, and
windows end before a pair that is not. A collision, or a map that is full of bits at very large sizes,
lets a window go on for nothing, and nothing is lost.

Words are numbered by a hash of 64 bits. Should two words of the tables share it, which is looked for, all
is done again with another seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, text_of
from tidemark.work import saved

LONGEST = 5
LEAST = 100
TOP = 2000
#: A candidate goes if a longer one holds it and has this percentage of its occurrences.
SHARE = 100
#: Bytes of text that are split at a time, and pairs that are sorted at a time: they bound a task's memory.
SLICE = 4 << 20
RUN = 4 << 20
#: Bits of the hash of a pair, of the map of frequent pairs; bytes of text for each range of hashes.
_HASH_BITS, _MAP_BITS, _RANGE_BYTES = 48, 27, 32 << 20
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_KINDS = np.zeros(256, np.uint8)  # of bytes: 1 is a blank, 2 ends a piece
_KINDS[[0x20, 0x09]] = 1
_KINDS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of some texts: of each its place in ``names``, its language, and whether the next one is
    in the same piece; 64-bit hashes of the names."""

    def __init__(self, langs: pa.Array, texts: pa.Array, seed: int) -> None:
        width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        at = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
        kinds = _KINDS[data]
        fresh = np.zeros(len(data) + 1, bool)  # a new text begins
        fresh[at[:-1] - at[0]] = True
        fresh = fresh[:-1]
        inside = kinds == 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | fresh[1:]
        first = np.flatnonzero(begins)
        piece = np.cumsum((kinds == 2) | fresh, dtype=np.int32)[first]
        ends = np.append(np.cumsum(inside, dtype=np.int32)[first] - 1, np.count_nonzero(inside)) if len(first) else np.zeros(1, np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[inside])]).dictionary_encode()
        self.codes = words.indices.to_numpy().astype(np.int32)
        self.names = words.dictionary
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) or 1 for w in self.names.to_pylist()], np.uint64)
        self.same = np.append(piece[1:] == piece[:-1], False) if len(first) else np.zeros(0, bool)
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary
        self.lang = coded.indices.to_numpy()[np.searchsorted(at[1:] - at[0], first, side="right")].astype(np.int32)
        self._salts = np.array([xxhash.xxh3_64_intdigest(x, seed + 1) for x in self.langs.to_pylist()], np.uint64)

    def pairs(self) -> np.ndarray:
        """A hash of each word, the next one and the language."""
        h = self.hashes[self.codes]
        mixed = h * _MIX[0] ^ (np.roll(h, -1) + self._salts[self.lang]) * _MIX[1]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MIX[2]
        return mixed >> np.uint64(64 - _HASH_BITS)


def _slices(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[Words]:
    """The words of (lang, text) rows, some texts at a time."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64))
        start = 0
        while start < len(sizes):
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + SLICE, side="right")))
            yield Words(batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start), seed)
            start = end


def _packed(values: np.ndarray) -> bytes:
    """Sorted numbers as a compressed run: differences, their low bytes first."""
    steps = np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.T).tobytes())


def _unpacked(run: bytes) -> np.ndarray:
    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(run), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(steps.T).view(np.uint64).ravel(), dtype=np.uint64)


def _frequent(texts: DataFrame, least: int, seed: int) -> np.ndarray:
    """The map of frequent pairs: at the first 27 bits of the hash of each one is a set bit."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(_MAP_BITS - 3, max(6, (size // _RANGE_BYTES).bit_length()))  # of ranges of hashes

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            pairs = np.sort(np.concatenate(held))
            held.clear()
            cuts = np.searchsorted(pairs, np.arange(1 << bits, dtype=np.uint64) << np.uint64(_HASH_BITS - bits))
            some = [(k, _packed(x)) for k, x in enumerate(np.split(pairs, cuts[1:])) if len(x)]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], names=["part", "run"])

        for words in _slices(batches, seed):
            held.append(words.pairs()[words.same])
            if sum(map(len, held)) >= RUN:
                yield flush()
        if sum(map(len, held)):
            yield flush()

    def merged(group: pa.Table) -> pa.Table:
        pairs = np.sort(np.concatenate([_unpacked(x.as_py()) for x in group.column("run")]), kind="stable")
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        often = pairs[first[np.diff(np.append(first, len(pairs))) >= least]]
        part = group.column("part")[0].as_py()
        places = (often >> np.uint64(_HASH_BITS - _MAP_BITS)).astype(np.int64) - (part << (_MAP_BITS - bits))
        flags = np.zeros(1 << (_MAP_BITS - bits), bool)
        flags[places] = True
        return pa.table({"part": pa.array([part], pa.int32()), "flags": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    parts = texts.mapInArrow(runs, "part int, run binary").groupBy("part").applyInArrow(merged, "part int, flags binary")
    width = 1 << (_MAP_BITS - bits - 3)
    out = np.zeros(1 << (_MAP_BITS - 3), np.uint8)
    for part, flags in parts.toLocalIterator():
        out[part * width : (part + 1) * width] = np.frombuffer(flags, np.uint8)
    return out


def _windows(texts: DataFrame, longest: int, least: int, seed: int) -> DataFrame:
    """lang, w1 to w<longest> and n: how often a task met a window, as hashes of words, 0 beyond its end. Rows
    with a word give the name of w1."""
    shared = texts.sparkSession.sparkContext.broadcast(_frequent(texts, least, seed))
    columns = [f"w{j + 1}" for j in range(longest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, named = shared.value, np.zeros(0, np.uint64)
        for words in _slices(batches, seed):
            if not len(words.codes):
                continue
            place = words.pairs() >> np.uint64(_HASH_BITS - _MAP_BITS)
            goes_on = words.same & (bits[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            table = {"lang": words.lang, "w1": words.codes}
            linked = goes_on
            for j in range(1, longest):
                table[columns[j]] = np.where(linked, np.append(words.codes[j:], np.full(min(j, len(words.codes)), -1, np.int32)), np.int32(-1))
                linked = linked & np.append(goes_on[j:], np.zeros(min(j, len(goes_on)), bool))
            counted = pa.table(table).group_by(["lang", *columns], use_threads=False).aggregate([([], "count_all")])
            hashes = np.append(words.hashes, np.uint64(0)).view(np.int64)  # the last one is for -1
            yield pa.RecordBatch.from_arrays(
                [words.langs.take(counted["lang"].combine_chunks()), *(pa.array(hashes[counted[c].to_numpy()]) for c in columns), counted["count_all"].combine_chunks(), pa.nulls(len(counted), pa.string())],
                names=["lang", *columns, "n", "word"],
            )
            new = np.flatnonzero(~np.isin(words.hashes, named))
            named = np.union1d(named, words.hashes)
            none = pa.nulls(len(new), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(new), pa.string()), pa.array(words.hashes[new].view(np.int64)), *([none] * longest), words.names.take(pa.array(new)).cast(pa.string())], names=["lang", *columns, "n", "word"]
            )

    return texts.mapInArrow(run, f"lang string, {', '.join(f'{c} long' for c in columns)}, n long, word string")


def _counted(texts: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, p, k, f) of phrases of k words that are frequent, (lang, n) and (w, word)."""
    columns = [f"w{j + 1}" for j in range(longest)]
    for seed in count():
        rows = saved(_windows(texts, longest, least, seed))
        names = rows.where("word IS NOT NULL").groupBy(F.col("w1").alias("w")).agg(F.min("word").alias("word"), F.max("word").alias("other"))
        names = saved(names)
        if names.where("word <> other").isEmpty():  # else two words share a hash
            break
    tops = rows.where("word IS NULL").groupBy("lang", *columns).agg(F.sum("n").alias("n"))
    rolled = tops.rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    words = F.filter(F.array(*columns), lambda w: w.isNotNull())
    # the leading columns that a sum keeps; its windows must reach to the last of them
    sums = rolled.where(f"g < {1 << longest}").select("lang", words.alias("p"), F.size(words).alias("k"), "f")
    sums = saved(sums.where((F.col("k") == 0) | (F.get("p", F.col("k") - 1) != 0) & (F.col("f") >= least)))
    return sums.where("k > 0"), sums.where("k = 0").select("lang", F.col("f").alias("n")), names.select("w", "word")


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(19,0)")


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, share: int = SHARE, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A to Z), split into pieces at punctuation and line ends and into words at blanks.
    Candidates are phrases of 2 to ``longest`` words with a >= ``least`` occurrences. Of its cuts the one with the
    lowest score floor(1000 a n / (l r)) counts, of equals the first. A candidate goes if a longer one that
    holds its words has ``share`` percent of its occurrences or more: as counts only fall with length, one that is a word
    longer does so if any does. Ties of score and a go by the phrase's bytes.

    Null texts are empty, and empty ones hold no words; a null language is `und`; rows that repeat count again;
    ids do not matter. An empty table, or a language without candidates, gives no rows; other columns are ignored.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    phrases, totals, names = _counted(texts, longest, least)
    candidates = phrases.where("k > 1")
    parts = F.explode(F.array(F.expr("slice(p, 1, k - 1)"), F.expr("slice(p, 2, k - 1)"))).alias("p")
    longer = candidates.where("k > 2").select("lang", parts, "f").groupBy("lang", "p").agg(F.max("f").alias("longer"))
    kept = candidates.join(longer, ["lang", "p"], "left").where(f"longer IS NULL OR 100 * longer < {share} * f")
    cuts = kept.select("lang", "p", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": F.expr("slice(p, 1, cut)"), "right": F.expr("slice(p, cut + 1, size(p) - cut)")})
    cuts = cuts.join(phrases.select("lang", F.col("p").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(phrases.select("lang", F.col("p").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(totals, "lang")
    cuts = cuts.withColumns({"above": F.lit(1000).cast("decimal(4,0)") * _exact("a") * _exact("n"), "below": _exact("l") * _exact("r")}).withColumn("score", F.expr("above div below"))
    best = cuts.groupBy("lang", "p", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")).select("lang", "p", "a", "n", "best.*")
    order = [F.desc("score"), F.desc("a")]
    first = durable(best.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "cut"))
    spelled = first.select("lang", "p", F.posexplode("p").alias("at", "w")).join(names, "w").groupBy("lang", "p").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    phrase = F.array_join(F.transform("words", lambda x: x["word"]), " ")
    named = first.join(spelled.select("lang", "p", phrase.alias("phrase")), ["lang", "p"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    return named.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), grams AS (
  SELECT lang, k, w[i:i + k - 1] AS p FROM starts, range(1, {LONGEST + 1}) AS ks(k) WHERE i + k - 1 <= len(w)
), f AS (
  SELECT lang, k, p, count(*) AS f FROM grams GROUP BY ALL
), n AS (
  SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT * FROM f WHERE k >= 2 AND f >= {LEAST}
), longer AS (
  SELECT DISTINCT c.lang, c.p FROM c JOIN c AS o ON o.lang = c.lang AND o.k > c.k AND 100 * o.f >= {SHARE} * c.f
    AND contains(' ' || array_to_string(o.p, ' ') || ' ', ' ' || array_to_string(c.p, ' ') || ' ')
), cuts AS (
  SELECT c.lang, c.p, c.f AS a, cut, l.f AS l, r.f AS r, n.n,
         1000 * c.f::HUGEINT * n.n::HUGEINT // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM c ANTI JOIN longer USING (lang, p), range(1, {LONGEST}) AS x(cut), f AS l, f AS r, n
  WHERE cut < c.k AND l.lang = c.lang AND l.p = c.p[:cut] AND r.lang = c.lang AND r.p = c.p[cut + 1:] AND n.lang = c.lang
), best AS (
  SELECT *, array_to_string(p, ' ') AS phrase FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank FROM best) WHERE rank <= {TOP}
"""
