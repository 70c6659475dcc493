"""Alignment of two tokenizers over a corpus, counted in sorted runs on disk.

Texts are cut where no token of either side can reach over: before single blanks, between a letter and a stop,
and around line ends. So a segment's tokens, groups and links are found once and kept, and a document is the
sum of its segments.

Each task gathers pair-document records (pair of ids, document, how often) and spills them as a run: sorted by the
radix of the A id, the A id and the B id, a compressed piece for each radix. Runs are files of the shared
folder and stay where they are. What travels is each run's list of pairs with the number of its documents:
a k-way heap merge of up to ``FAN`` lists counts each pair, merged lists meet again until one is left for a
radix. There an A id's pairs are neighbours, which gives its largest count. The counts stream back the
way they came, to each list's own pairs, down to the runs, where they meet the records and become each
document's sums. A pair that every document holds is one entry per list, however often it occurs.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.bpe import _byte_letters, read_description
from tidemark.llm.common import id_and_text
from tidemark.work import saved

#: Documents and records of a run, bytes of text that are cut at a time, segments kept in a worker: a task's memory.
RUN_DOCS, RUN_RECORDS, SLICE, KEPT = 4096, 3_000_000, 4 << 20, 400_000
#: Lists that meet in one merge.
FAN = 128
_RADIX = 6  # bits
_LETTER, _STOP = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r".,;:!?"
#: Segments of a text with a blank before it: letters up to a stop, line end or single blank; stops up to a line end or
#: single blank; a line end; anything up to a single blank. Blanks belong to what follows.
_SEGMENT = re.compile(rf" ?[{_LETTER}]+(?=[{_STOP}\n]| \S|\Z)| ?[{_STOP}]+(?=\n| \S|\Z)|\n(?=\S)|.+?(?:(?<=\S)(?= \S)|\Z)", re.S)
_ACROSS = re.compile(rf"[{_LETTER}][{_STOP}]|\n|.\u2581")
_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_RUN = f"run long, part int, pairs binary, held binary, docs binary, times binary, place int, {_DOC}"


class Segments:
    """Tokens, groups and links of segments, each found once."""

    def __init__(self, byte_bpe: str, piece_bpe: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        spec = json.loads(byte_bpe)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        inner = [p for p in pieces if _ACROSS.search(p.lstrip("▁"))]
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or not spec["pre_tokenizer"]["use_regex"] or inner or max(len(pieces), self.a.get_vocab_size()) > 1 << 16:
            raise ValueError("tokens may reach over a cut, or ids pass 16 bits")
        byte_of = {letter: b for b, letter in enumerate(_byte_letters())}
        a_bytes = {i: bytes(map(byte_of.__getitem__, t)) if all(c in byte_of for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_lengths, self.b_lengths = (np.array([*map(len, x)]) for x in (self.a_bytes, self.b_bytes))
        # how ids are written in lists: an A id before another or before the B ids, a B id before another, before a group, last
        written = [f"{i}{c}" for i in range(len(self.a_bytes)) for c in ",|"] + [f"{i}{c}" for i in range(len(pieces)) for c in ",;\n"]
        self.written = np.array(written, object)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.text: list[str] = []  # of groups
        self.sizes = array("i")  # tokens of A and B, groups, links; 0 groups if the tokens' bytes are not the text's
        self.pairs, self.ends = array("I"), array("q", [0])

    def codes(self, segments: list[str]) -> np.ndarray:
        """The number of each segment, new ones added."""
        new = [s for s in set(segments) if s not in self.index]
        if new:
            self._add(new)
        return np.fromiter(map(self.index.__getitem__, segments), np.int32, len(segments))

    def _add(self, new: list[str]) -> None:
        a = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        # this side puts a blank before a text; two tokens, the blank and a line end, precede what has none
        b = self.b.encode([s[1:] if s[0] == " " else f"\n{s}" for s in new], num_threads=1)
        b = [ids if s[0] == " " else ids[2:] for s, ids in zip(new, b, strict=True)]
        if not (self._bytes(a, self.a_bytes) == self._bytes(b, self.b_bytes) == "".join(new).encode()):
            same = [self._bytes([x], self.a_bytes) == self._bytes([y], self.b_bytes) == s.encode() for s, x, y in zip(new, a, b, strict=True)]
            for s in (s for s, ok in zip(new, same, strict=True) if not ok):
                self.index[s] = len(self.text)
                self.text.append("")
                self.sizes.extend((0, 0, 0, 0))
                self.ends.append(len(self.pairs))
            new, a, b = ([x for x, ok in zip(xs, same, strict=True) if ok] for xs in (new, a, b))
        if new:
            self.index |= {s: len(self.text) + i for i, s in enumerate(new)}
            self._align(a, b)

    @staticmethod
    def _bytes(ids: list[list[int]], spelled: list[bytes]) -> bytes:
        return b"".join(map(spelled.__getitem__, chain.from_iterable(ids)))

    def _align(self, a: list[list[int]], b: list[list[int]]) -> None:
        """Groups and links of segments whose tokens spell them, all at once: positions are bytes of the
        segments put one after another."""
        (a_ids, a_counts), (b_ids, b_counts) = _flat(a), _flat(b)
        a_ends, b_ends = np.cumsum(self.a_lengths[a_ids]), np.cumsum(self.b_lengths[b_ids])
        last = a_ends[np.cumsum(a_counts) - 1]  # of each segment
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)  # where groups end
        every = np.union1d(a_ends, b_ends)  # what lies between two of them is the overlap of a pair
        links = pair_code(a_ids[np.searchsorted(a_ends, every)], b_ids[np.searchsorted(b_ends, every)]).astype(np.uint32)
        n_groups, n_links = (np.bincount(np.searchsorted(last, x), minlength=len(last)) for x in (common, every))
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        # the ids of A and of B, group by group, and what is written after each
        order = np.empty(len(a_ids) + len(b_ids), np.int64)
        order[np.arange(len(a_ids)) + np.searchsorted(b_group, a_group)] = 2 * a_ids + (common[a_group] == a_ends)
        after = (common[b_group] == b_ends).astype(np.int64)
        after[np.cumsum(b_counts) - 1] = 2
        order[np.arange(len(b_ids)) + np.searchsorted(a_group, b_group, side="right")] = 2 * len(self.a_bytes) + 3 * b_ids + after
        self.text += "".join(self.written[order].tolist()).split("\n")[:-1]
        self.sizes.frombytes(np.stack([a_counts, b_counts, n_groups, n_links], axis=1).astype(np.int32).tobytes())
        self.ends.frombytes((np.cumsum(n_links) + len(self.pairs)).astype(np.int64).tobytes())
        self.pairs.frombytes(links.tobytes())


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(lists), np.int64), np.array([*map(len, lists)], np.int64)


def pair_code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers for pairs of ids whose first bits are the radix of a; pairs of one a are neighbours."""
    return (a & ((1 << _RADIX) - 1)) << 26 | a >> _RADIX << 16 | b


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpack(run: bytes, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(run), kind)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=np.uint32(0)))


def _unpack_sorted(run: bytes) -> np.ndarray:
    return np.cumsum(_unpack(run), dtype=np.uint32)


class _Run:
    """What a task gathers until it spills: rows of documents, and the segments of each."""

    def __init__(self) -> None:
        self.docs: list[tuple] = []
        self.keys: list[np.ndarray] = []  # pair and place of the document
        self.times: list[np.ndarray] = []
        self.records = 0

    def add(self, ids: list, texts: list[str], segments: Segments) -> None:
        cut = [_SEGMENT.findall(f" {t}") for t in texts]
        counts = np.array([len(c) for c in cut])
        codes = segments.codes([s for c in cut for s in c])
        sizes = np.frombuffer(segments.sizes, np.int32).reshape(-1, 4)[codes].astype(np.int64)
        starts = np.cumsum(counts) - counts
        sums, whole = np.add.reduceat(sizes, starts), np.minimum.reduceat(sizes[:, 2], starts) > 0
        whole &= np.array([bool(t) for t in texts])
        for k, (id_, n) in enumerate(zip(ids, counts.tolist(), strict=True)):
            if whole[k]:
                groups = ";".join([segments.text[c] for c in codes[starts[k] : starts[k] + n].tolist()])
                self.docs.append((id_, *sums[k].tolist(), hashlib.sha256(groups.encode()).hexdigest()))
            else:
                self.docs.append((id_, 0, 0, 0, 0, ""))
        keep = np.repeat(whole, counts)
        owner = np.repeat(np.arange(len(self.docs) - len(texts), len(self.docs)), counts)
        distinct, often = np.unique(owner[keep] << 32 | codes[keep], return_counts=True)
        # the links of each segment of each document
        code, ends = distinct & 0xFFFFFFFF, np.frombuffer(segments.ends, np.int64)
        n = ends[code + 1] - ends[code]
        at = np.arange(n.sum()) + np.repeat(ends[code] - (np.cumsum(n) - n), n)
        keys = np.frombuffer(segments.pairs, np.uint32)[at].astype(np.uint64) << np.uint64(32) | np.repeat(distinct >> 32, n).astype(np.uint64)
        keys, times = _summed(keys, np.repeat(often, n).astype(np.uint64))
        self.keys.append(keys)
        self.times.append(times)
        self.records += len(keys)

    def rows(self, run: int) -> Iterator[pa.RecordBatch]:
        """The run's pieces by radix, and its documents."""
        keys, times = _summed(np.concatenate(self.keys), np.concatenate(self.times))
        pairs, docs = (keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32)
        cuts = np.searchsorted(pairs, np.arange(1, 1 << _RADIX, dtype=np.uint32) << np.uint32(32 - _RADIX))
        pieces = []
        for part, (p, d, t) in enumerate(zip(np.split(pairs, cuts), np.split(docs, cuts), np.split(times, cuts), strict=True)):
            if len(p):
                first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
                held = np.diff(np.append(first, len(p))).astype(np.uint32)
                pieces.append((part, _pack_sorted(p[first]), _pack(held), _pack(d), _pack(t.astype(np.uint32))))
        yield _batch([(run, *piece, None, *[None] * 6) for piece in pieces], _RUN)
        yield _batch([(run, None, None, None, None, None, place, *doc) for place, doc in enumerate(self.docs)], _RUN)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(values, first)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _table(rows: list[tuple], schema: str) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, schema)])


_LOADED: dict[int, Segments] = {}


def _loaded(shipped: Broadcast[tuple[str, bytes]]) -> Segments:
    byte_bpe, piece_bpe = shipped.value
    if (key := hash(byte_bpe) ^ hash(piece_bpe)) not in _LOADED:
        _LOADED[key] = Segments(byte_bpe, piece_bpe)
    return _LOADED[key]


def _runs(docs: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """Runs of pair-document records by radix (part), and the rows of their documents (no part)."""
    with open(piece_bpe, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast((read_description(byte_bpe), f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, now, number = _loaded(shipped), _Run(), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, sizes, start = batch.column(0).to_pylist(), batch.column(1).nbytes, 0
            step = max(1, min(RUN_DOCS, len(ids) * SLICE // max(1, sizes)))
            while start < len(ids):
                if len(segments.index) > KEPT:
                    segments.clear()
                end = min(start + step, len(ids))
                now.add(ids[start:end], batch.column(1).slice(start, end - start).to_pylist(), segments)
                start = end
                if now.records > RUN_RECORDS or len(now.docs) >= RUN_DOCS:
                    yield from now.rows(number)
                    now, number = _Run(), number + 1
        if now.docs:
            yield from now.rows(number)

    return id_and_text(docs).mapInArrow(run, _RUN)


_LIST = "part int, node long, pairs binary, counts binary"


def _merged(group: pa.Table, nodes: int) -> pa.Table:
    """One list from several: a heap holds the next pair of each."""
    lists = [zip(_unpack_sorted(p).tolist(), _unpack(c, np.uint64).tolist(), strict=True) for p, c in zip(group["pairs"].to_pylist(), group["counts"].to_pylist(), strict=True)]
    pairs, counts = array("L"), array("L")
    for pair, same in groupby(heapq.merge(*lists, key=itemgetter(0)), itemgetter(0)):
        pairs.append(pair)
        counts.append(sum(n for _, n in same))
    return _table([(group["part"][0].as_py(), group["node"][0].as_py() % nodes, _pack_sorted(np.array(pairs, np.uint32)), _pack(np.array(counts, np.uint64)))], _LIST)


class _Answer(NamedTuple):
    """Corpus-wide counts of some sorted pairs, and whether a count is its A id's highest."""

    pairs: np.ndarray
    counts: np.ndarray
    best: np.ndarray

    def of(self, pairs: np.ndarray) -> _Answer:
        at = np.searchsorted(self.pairs, pairs)
        return _Answer(pairs, self.counts[at], self.best[at])


_ANSWER = "part int, node long, pairs binary, counts binary, best binary"


def _highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers from final lists: an A id's pairs are neighbours there."""
    for batch in batches:
        rows = []
        for part, node, p, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            a, counts = _unpack_sorted(p) >> np.uint32(16), _unpack(c, np.uint64)
            first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            most = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(a))))
            rows.append((part, node, p, c, _pack((counts == most).astype(np.uint8))))
        yield _batch(rows, _ANSWER)


def _answer(above: pa.Table) -> _Answer:
    (p,), (c,), (b,) = (above[x].to_pylist() for x in ("pairs", "counts", "best"))
    return _Answer(_unpack_sorted(p), _unpack(c, np.uint64), _unpack(b, np.uint8))


def _passed_down(lists: pa.Table, above: pa.Table) -> pa.Table:
    """The answers of lists from that of the list that they were merged into."""
    whole, rows = _answer(above), []
    for part, node, p in zip(*(lists[x].to_pylist() for x in ("part", "node", "pairs")), strict=True):
        own = whole.of(_unpack_sorted(p))
        rows.append((part, node, p, _pack(own.counts), _pack(own.best)))
    return _table(rows, _ANSWER)


_SHARE = "run long, places binary, best binary, total binary"


def _shares(runs: pa.Table, above: pa.Table) -> pa.Table:
    """What a run's records of one radix add to its documents."""
    whole, rows = _answer(above), []
    for run, *pieces in zip(*(runs[x].to_pylist() for x in ("run", "pairs", "held", "docs", "times")), strict=True):
        pairs, (held, docs, times) = _unpack_sorted(pieces[0]), map(_unpack, pieces[1:])
        own = whole.of(pairs)
        counts, best, times = np.repeat(own.counts, held), np.repeat(own.best, held), times.astype(np.uint64)
        order = np.argsort(docs, kind="stable")
        docs = docs[order]
        first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
        total, most = np.add.reduceat((counts * times)[order], first), np.add.reduceat((best * times)[order], first)
        rows.append((run, _pack_sorted(docs[first]), _pack(most), _pack(total)))
    return _table(rows, _SHARE)


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed_up(docs: pa.Table, shares: pa.Table) -> pa.Table:
    """The rows of a run's documents with the sums of what all radixes add."""
    sums = np.zeros((2, docs.num_rows), np.uint64)  # places are 0, 1, 2, ...
    for places, *added in zip(*(shares[x].to_pylist() for x in ("places", "best", "total")), strict=True):
        at = _unpack_sorted(places)
        for k, x in enumerate(added):
            sums[k, at] += _unpack(x, np.uint64)
    best, total = (x[docs["place"].to_numpy()].astype(np.int64) for x in sums)
    return docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total)).append_column("groups_sha256", docs["groups_sha256"])


def align(docs: DataFrame, byte_bpe: str, piece_bpe: str, fan: int = FAN) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    byte_bpe and piece_bpe are vocabulary files of a byte-level BPE (A) and of pieces with byte fallback (B); the
    driver reads them and broadcasts two megabytes. Special tokens in texts are plain text. Groups end where tokens of
    both end; links are pairs of tokens that overlap; a pair's count is the number of documents that hold it
    linked, and repeated rows are documents of their own, whatever their ids.

    Null and empty texts, and those whose tokens do not spell them (a text that holds U+2581), have no
    tokens: zeros, and an empty string for the digest. An empty table gives no rows; other columns are ignored.
    """
    rows = saved(_runs(docs, byte_bpe, piece_bpe))
    runs = rows.where("part IS NOT NULL")
    n = runs.select("run").distinct().count()
    # runs are dealt to the first lists by hash, lists to the next ones by number
    widths = []
    while not widths or widths[-1] > 1:
        widths.append(max(1, -(-(widths[-1] if widths else n) // fan)))
    first = F.pmod(F.xxhash64("run"), F.lit(widths[0]))

    def merge(lists: DataFrame, nodes: int) -> DataFrame:
        return saved(lists.groupBy("part", _next(nodes)).applyInArrow(lambda group: _merged(group, nodes), _LIST))

    own = runs.select("part", first.alias("node"), "pairs", "held")
    levels = [merge(own.mapInArrow(_widened, _LIST), widths[0])]
    for nodes in widths[1:]:
        levels.append(merge(levels[-1], nodes))
    answers = levels[-1].mapInArrow(_highest, _ANSWER)
    for lists, nodes in zip(levels[-2::-1], widths[:0:-1], strict=True):
        answers = saved(lists.groupBy("part", _next(nodes)).cogroup(answers.groupBy("part", "node")).applyInArrow(_passed_down, _ANSWER))
    shares = runs.withColumn("node", first).groupBy("part", "node").cogroup(answers.groupBy("part", "node")).applyInArrow(_shares, _SHARE)
    told = rows.where("part IS NULL").select("run", "place", *(f.split()[0] for f in _DOC.split(", ")))
    return told.groupBy("run").cogroup(shares.groupBy("run")).applyInArrow(_summed_up, _RESULT)


def _next(nodes: int) -> Column:
    return F.pmod("node", F.lit(nodes))


def _widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [_pack(_unpack(x.as_py()).astype(np.uint64)) for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.binary())], names=["part", "node", "pairs", "counts"])
