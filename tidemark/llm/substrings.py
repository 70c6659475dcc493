"""Removal of repeated byte strings by content-defined sampling of windows.

Sorting every suffix of a corpus moves a tuple per byte: five bytes each are already several times
the input. No suffix array is built here: windows are represented by sampled grams, and equal ones are
found by grouping. A window of ``LENGTH`` bytes is represented by the least hash of its grams
(leftmost of equals): equal windows choose the same gram at the same place, wherever they are.
Neighbouring windows mostly choose the same occurrence; such a stretch is one tuple: gram,
digest of the stretch, document, position and extent. About one tuple arises for 40 bytes.

Tuples are sorted by (gram, digest, document, position) in shards by gram, in Spark's disk-backed
shuffle. In the sorted order, a tuple equal to the one before it has only windows that come earlier,
and is a repeat as a whole; a gram that occurs once is none. What is left, different stretches
around one gram, is compared window by window on its bytes, aligned at the gram, and the windows that
an earlier stretch has are repeats. Byte spans of repeats then go to their documents.

Where very many different stretches surround one gram, as a license line does in many documents, they
do not meet: each of their windows becomes a row of its own (96 bits of hash, document, place), the
least place of equal windows is taken task by task, and what is left is dealt by the window's hash.
Such grams are found before any tuple moves, from a sample of whole documents of bounded size; one
that the sample does not show is found in its shard, and then dealt in the same way.

Equal tuples of a task are combined before anything moves, so a passage that very many documents
share is one tuple per task. A shard is one task's, and its size in bytes of text is fixed: the number
of shards grows with the input, whatever the number of shuffle partitions. Texts move compressed, many
to a row; very long ones are read in overlapping segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, id_and_text, whole_runs

LENGTH = 100
GRAM = 24
#: Bytes of texts that are hashed at once, and windows of a segment of a long text.
CHUNK, SEGMENT = 1_500_000, 1_000_000
#: Bytes of texts of a task that are packed together.
PACKED = 16_000_000
#: Different stretches around one gram, above which their windows are dealt one by one.
HEADS = 20_000
#: Bytes of texts to a shard, if there are more than one for each shuffle partition; shards of windows
#: are so many times more.
SHARD, FINER = 32_000_000, 8
#: Bytes of whole documents that very common grams are looked for in (in expectation), and stretches
#: of the sample that tell of one: at most SAMPLE / 40 / SEEN grams, a megabyte, are broadcast.
SAMPLE, SEEN = 64_000_000, 16
_WINDOW = LENGTH - GRAM + 1
_PLACE = 24  # bits of a place within a chunk

_RANDOM = np.random.default_rng(20240501)  # fixed: every worker hashes alike
_BYTE = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: A second hash, for windows that are compared without their bytes.
_BYTE2 = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE2 = np.uint64(0x9FB21C651E98DF25)
_INVERSE2 = np.uint64(pow(int(_BASE2), -1, 1 << 64))


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """base^i for i below a growing size, kept per worker."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.values = base, np.ones(1, np.uint64)

    def to(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            self.values = np.concatenate([self.values, self.values * _power(self.base, len(self.values))])
        return self.values[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)
_UP2, _DOWN2 = _Powers(_BASE2), _Powers(_INVERSE2)


def _prefix_hashes(data: np.ndarray, byte: np.ndarray = _BYTE, up: _Powers = _UP) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte[data] * up.to(len(data)), out=sums[1:])
    return sums


def _shard_of(docs: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a document's text and spans: by a hash of its id, as ids may have any pattern."""
    return (_mixed(docs.astype(np.int64).view(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, down: _Powers = _DOWN) -> np.ndarray:
    """Hashes of the strings [start, end), alike for equal strings at any place."""
    return (sums[end] - sums[start]) * down.to(len(sums))[start]


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash for each gram, by doubling: 1, 2, 4, 8, 16 bytes and 16 + 8."""
    h = _BYTE[data]
    sizes = {1: h}
    for n in (1, 2, 4, 8):
        h = h[:-n] * _power(_BASE, n) + h[n:]
        sizes[2 * n] = h
    return _mixed(sizes[16][: len(data) - GRAM + 1] * _power(_BASE, 8) + sizes[8][16 : 16 + len(data) - GRAM + 1])


def _least_of_windows(keys: np.ndarray) -> np.ndarray:
    m, size = keys, 1
    while 2 * size <= _WINDOW:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    n = len(keys) - _WINDOW + 1
    return np.minimum(m[:n], m[_WINDOW - size : _WINDOW - size + n])


#: Columns of tuples: gram (48 bits, in two columns; grams that share them are told apart by their
#: bytes), digest, document, first window, gram's place after it, further windows.
TUPLE = (("gram", "<u4"), ("gram2", "<u2"), ("digest", "<u8"), ("doc", "<i8"), ("lo", "<u4"), ("at", "u1"), ("more", "u1"))
SPAN = (("doc", "<i8"), ("lo", "<u4"), ("end", "<u4"))
WINDOW = (("key", "<u8"), ("check", "<u4"), ("doc", "<i8"), ("lo", "<u4"))
#: Set in a tuple's further windows, of which there are fewer, if its windows are dealt one by one.
_HOT = np.uint8(128)
Columns = dict[str, np.ndarray]


def _pack(cols: Columns, layout: tuple, rows: slice) -> bytes:
    return b"".join(cols[name][rows].astype(kind, copy=False).tobytes() for name, kind in layout)


def _unpack(blobs: list[bytes], layout: tuple) -> Columns:
    width = sum(np.dtype(kind).itemsize for _, kind in layout)
    parts: dict[str, list[np.ndarray]] = {name: [] for name, _ in layout}
    for blob in blobs:
        n, at = len(blob) // width, 0
        for name, kind in layout:
            parts[name].append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {name: np.concatenate(parts[name]) if blobs else np.empty(0, kind) for name, kind in layout}


def _gram(cols: Columns) -> np.ndarray:
    return cols["gram"].astype(np.uint64) << np.uint64(16) | cols["gram2"].astype(np.uint64)


def _in_text_order(cols: Columns) -> Columns:
    """By document and place: neighbouring rows are then alike, which compression makes use of."""
    return _taken(cols, np.lexsort((cols["lo"], cols["doc"])))


def _taken(cols: Columns, rows: np.ndarray) -> Columns:
    return {k: v[rows] for k, v in cols.items()}


def tuples_of(pieces: list[tuple[int, int, bytes]]) -> tuple[Columns, bytes]:
    """Tuples of (document, offset, bytes) pieces, in the order of the pieces, and the joined bytes, in
    which the further column place tells where each tuple's stretch starts."""
    pieces = [p for p in pieces if len(p[2]) >= LENGTH]
    joined = b"".join(p[2] for p in pieces)
    if not pieces:
        return {name: np.empty(0, kind) for name, kind in TUPLE} | {"place": np.empty(0, np.int64)}, joined
    data = np.frombuffer(joined, np.uint8)
    lengths = np.array([len(p[2]) for p in pieces])
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
    places = np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    grams = _grams(data)
    least = _least_of_windows(((grams >> np.uint64(_PLACE)) << np.uint64(_PLACE)) | places)
    chosen = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    windows = np.nonzero(piece[: len(data) - LENGTH + 1] == piece[LENGTH - 1 :])[0]  # within one piece
    chosen = chosen[windows]
    first = np.ones(len(windows), bool)
    first[1:] = (chosen[1:] != chosen[:-1]) | (windows[1:] != windows[:-1] + 1) | (piece[windows[1:]] != piece[windows[:-1]])
    starts = np.nonzero(first)[0]
    ends = np.append(starts[1:], len(windows)) - 1
    lo, hi, at = windows[starts], windows[ends], chosen[starts]
    sums = _prefix_hashes(data)
    of = piece[lo]
    offset = np.array([p[1] for p in pieces]) - (np.cumsum(lengths) - lengths)
    return {
        "gram": (grams[at] >> np.uint64(32)).astype(np.uint32),
        "gram2": (grams[at] >> np.uint64(16)).astype(np.uint16),
        "digest": _mixed(_between(sums, lo, hi + LENGTH) + ((at - lo) * 128 + hi - lo).astype(np.uint64)),
        "doc": np.array([p[0] for p in pieces], np.int64)[of],
        "lo": (lo + offset[of]).astype(np.uint32),
        "at": (at - lo).astype(np.uint8),
        "more": (hi - lo).astype(np.uint8),
        "place": lo,
    }, joined


def _spans_of(tuples: Columns) -> Columns:
    return {"doc": tuples["doc"], "lo": tuples["lo"], "end": tuples["lo"] + tuples["more"] + np.uint32(LENGTH)}


def _firsts(tuples: Columns) -> tuple[Columns, np.ndarray, np.ndarray]:
    """(sorted tuples, which are the first with their gram and digest, which others are repeats).
    An occurrence that is there twice, as a row is repeated, is no repeat of itself."""
    gram = _gram(tuples)
    order = np.lexsort((tuples["lo"], tuples["doc"], tuples["digest"], gram))
    s, gram = _taken(tuples, order), gram[order]
    first = np.ones(len(order), bool)
    first[1:] = (gram[1:] != gram[:-1]) | (s["digest"][1:] != s["digest"][:-1])
    head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return s, first, ~first & ((s["doc"] != s["doc"][head]) | (s["lo"] != s["lo"][head]))


def _by_shard(cols: Columns, layout: tuple, shard: np.ndarray, kind: int, extra: list[bytes] | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(shard, kind, packed rows) for each shard that has rows; extra: a string of each row, put at
    the end of the packed rows."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    cols, shard = _taken(cols, order), shard[order]
    starts = np.nonzero(np.append(True, shard[1:] != shard[:-1]))[0]
    for a, b in zip(starts, [*starts[1:], len(shard)], strict=True):
        packed = _pack(cols, layout, slice(a, b))
        if extra is not None:
            packed = int(b - a).to_bytes(4, "little") + packed + b"".join(extra[i] for i in order[a:b])
        yield int(shard[a]), kind, packed


_SHARDED = "shard long, kind int, packed binary"
_TUPLES, _SPANS, _ASKED, _WINDOWS, _TEXTS = 0, 1, 2, 3, 9


def _sharded_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    s, k, p = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(k, pa.int32()), pa.array(p, pa.binary())], names=["shard", "kind", "packed"])


def _chunks(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, bytes]]]:
    """Pieces of the batch's texts in the order of documents, about ``CHUNK`` bytes at a time."""
    keys = batch.column("doc_id").to_numpy()
    held, size = [], 0
    for i in np.argsort(keys, kind="stable").tolist():
        data = batch.column("text")[i].as_py().encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(data) - LENGTH + 1), SEGMENT):
            held.append((int(keys[i]), at, data[at : at + SEGMENT + LENGTH - 1]))
            size += len(held[-1][2])
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def common_grams(docs: DataFrame, size: int, heads: int) -> np.ndarray:
    """Sorted grams around which more than ``heads`` different stretches are to be expected, by a sample of
    documents (all, if their ``size`` in bytes is small)."""
    share = min(1.0, SAMPLE / max(size, 1))
    chosen = docs if share == 1 else docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pieces in _chunks(batch):
                t, _ = tuples_of(pieces)
                found = np.unique(np.stack([_gram(t).view(np.int64), t["digest"].view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["gram", "digest"])

    counts = chosen.mapInArrow(run, "gram long, digest long").distinct().groupBy("gram").agg(F.count("*").alias("n"))
    least = heads if share == 1 else max(heads * share, SEEN)
    return np.array(sorted(r.gram for r in counts.where(F.col("n") > least).select("gram").collect()), np.int64).view(np.uint64)


def _is_in(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ``some``."""
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values if len(some) else np.zeros(len(values), bool)


def _strings(t: Columns, joined: bytes) -> list[bytes]:
    """The bytes of stretches."""
    return [joined[at : at + more + LENGTH] for at, more in zip(t["place"].tolist(), t["more"].tolist(), strict=True)]


def _dealt_windows(t: Columns, strings: list[bytes], shards: int) -> Iterator[tuple[int, int, bytes]]:
    """The first of equal windows of stretches by shard of their hash, and spans of the others."""
    for at in range(0, len(strings), HEADS):
        heads, spans = _first_windows(_window_rows(_taken(t, slice(at, at + HEADS)), strings[at : at + HEADS]))
        heads = _in_text_order(heads)
        yield from _by_shard(heads, WINDOW, shards + (heads["key"] % np.uint64(FINER * shards)).astype(np.int64), _WINDOWS)
        yield from _by_shard(spans, SPAN, _shard_of(spans["doc"], shards), _SPANS)


def _suffix_tuples(docs: DataFrame, shards: int, common: np.ndarray = np.empty(0, np.uint64)) -> DataFrame:
    """Packed tuples by shard of their gram, windows of ``common`` grams by shard of their hash, and spans
    of repeats within a chunk by shard of their document."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pieces in _chunks(batch):
                t, joined = tuples_of(pieces)
                s, first, repeat = _firsts(t)
                spans = _in_text_order(_spans_of(_taken(s, repeat)))
                hot = _is_in(_gram(s), shared.value)
                kept, dealt = _in_text_order(_taken(s, first & ~hot)), _taken(s, first & hot)
                rows = [*_by_shard(kept, TUPLE, (_gram(kept) % np.uint64(shards)).astype(np.int64), _TUPLES), *_by_shard(spans, SPAN, _shard_of(spans["doc"], shards), _SPANS)]
                yield _sharded_batch([*rows, *_dealt_windows(dealt, _strings(dealt, joined), shards)])

    return docs.mapInArrow(run, _SHARDED)


def _sorted_shards(rows: DataFrame, shards: int, *within: str) -> DataFrame:
    """Each shard in one task, with those of its windows, which are dealt over the same tasks."""
    return rows.repartitionById(shards, F.pmod("shard", F.lit(shards)).cast("int")).sortWithinPartitions("shard", *within)


def _resolved(tuples: DataFrame, shards: int, most: int) -> DataFrame:
    """Spans of tuples that repeat an earlier one, and tuples whose bytes are asked for, both by
    shard of their document. Those of more than ``most`` around one gram are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["shard"]):
            kinds = table.column("kind").to_numpy()
            rows = []
            for shard, kind, packed in zip(table.column("shard").to_pylist(), kinds, table.column("packed"), strict=True):
                if kind == _SPANS:
                    rows.append((shard, _SPANS, packed.as_py()))
            for one in np.unique(table.column("shard").to_numpy()):
                of = table.column("shard").to_numpy() == one
                windows = np.nonzero(of & (kinds == _WINDOWS))[0].tolist()
                if windows:
                    _, spans = _first_windows(_unpack([table.column("packed")[i].as_py() for i in windows], WINDOW))
                    rows += _by_shard(spans, SPAN, _shard_of(spans["doc"], shards), _SPANS)
                t = _unpack([table.column("packed")[i].as_py() for i in np.nonzero(of & (kinds == _TUPLES))[0].tolist()], TUPLE)
                gram = _gram(t)
                by_gram = np.sort(gram)
                again = np.unique(by_gram[1:][by_gram[1:] == by_gram[:-1]])
                if not len(again):
                    continue
                place = np.minimum(np.searchsorted(again, gram), len(again) - 1)
                s, first, repeat = _firsts(_taken(t, again[place] == gram))
                spans = _in_text_order(_spans_of(_taken(s, repeat)))
                rows += _by_shard(spans, SPAN, _shard_of(spans["doc"], shards), _SPANS)
                heads = _taken(s, first)
                g = _gram(heads)
                _, of, count = np.unique(g, return_inverse=True, return_counts=True)
                heads["more"] = heads["more"] | np.where(count[of] > most, _HOT, np.uint8(0))
                asked = _in_text_order(_taken(heads, count[of] > 1))
                rows += _by_shard(asked, TUPLE, _shard_of(asked["doc"], shards), _ASKED)
            yield _sharded_batch(rows)

    return _sorted_shards(tuples, shards).mapInArrow(run, _SHARDED)


def _packed_texts(docs: DataFrame, shards: int) -> DataFrame:
    """Documents by shard, many to a row: their number, ids and lengths, and their bytes, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)

        def packed(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
            by_shard: dict[int, list[tuple[int, bytes]]] = {}
            for doc, data in held:
                by_shard.setdefault(int(_shard_of(np.array([doc]), shards)[0]), []).append((doc, data))
            rows = []
            for shard, of in by_shard.items():
                head = np.array([len(of), *(d for d, _ in of), *(len(x) for _, x in of)], "<i8").tobytes()
                rows.append((shard, _TEXTS, packer.compress(head + b"".join(x for _, x in of))))
            return _sharded_batch(rows)

        for batch in batches:
            held, size = [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                held.append((doc, text.as_py().encode("utf-8", "surrogatepass")))
                size += len(held[-1][1])
                if size >= PACKED:
                    yield packed(held)
                    held, size = [], 0
            if held:
                yield packed(held)

    return docs.mapInArrow(run, _SHARDED)


def _unpacked_texts(packed: bytes) -> list[tuple[int, bytes]]:
    data = zstandard.ZstdDecompressor().decompress(packed)
    n = int.from_bytes(data[:8], "little")
    ids, lengths = np.frombuffer(data, "<i8", n, 8).tolist(), np.frombuffer(data, "<i8", n, 8 + 8 * n)
    ends = (8 + 16 * n + np.cumsum(lengths)).tolist()
    return [(doc, data[end - length : end]) for doc, length, end in zip(ids, lengths.tolist(), ends, strict=True)]


def _with_texts(docs: DataFrame, packed: DataFrame, shards: int) -> DataFrame:
    """Documents and what is packed for them, shard by shard, packed rows first."""
    return _sorted_shards(_packed_texts(docs, shards).unionByName(packed.select("shard", "kind", "packed")), shards, "kind")


def _streamed(batches: Iterator[pa.RecordBatch], layout: tuple) -> Iterator[tuple[Columns, list[tuple[int, bytes]]]]:
    """(packed rows of the documents' shard sorted by document, some documents of the shard)."""
    shard, blobs, cols = None, [], _unpack([], layout)
    docs: list[tuple[int, bytes]] = []
    size = 0
    for batch in batches:
        for at, kind, packed in zip(batch.column("shard").to_pylist(), batch.column("kind").to_pylist(), batch.column("packed"), strict=True):
            if docs and (at != shard or size >= PACKED):
                yield cols, docs
                docs, size = [], 0
            if at != shard:
                shard, blobs, cols = at, [], _unpack([], layout)
            if kind != _TEXTS:
                blobs.append(packed.as_py())
                continue
            if blobs:
                cols, blobs = _unpack(blobs, layout), []
                cols = _taken(cols, np.lexsort((cols["lo"], cols["doc"])))
            docs += (more := _unpacked_texts(packed.as_py()))
            size += sum(len(x) for _, x in more)
    if docs:
        yield cols, docs


def _stretches(docs: DataFrame, asked: DataFrame, shards: int) -> DataFrame:
    """The tuples asked for with the bytes of their stretches, by shard of their gram; of those that
    are marked, the first of equal windows by shard of their hash, and the spans of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, docs in _streamed(batches, TUPLE):
            rows, strings = [], []
            for doc, data in docs:
                a, b = np.searchsorted(cols["doc"], [doc, doc + 1])
                rows.append(np.arange(a, b))
                strings += [data[lo : lo + more + LENGTH] for lo, more in zip(cols["lo"][a:b].tolist(), (cols["more"][a:b] & ~_HOT).tolist(), strict=True)]
            t = _taken(cols, np.concatenate(rows))
            hot = t["more"] >= _HOT
            t["more"] = t["more"] & ~_HOT
            few, many = np.nonzero(~hot)[0], np.nonzero(hot)[0]
            c = _taken(t, few)
            yield _sharded_batch(list(_by_shard(c, TUPLE, (_gram(c) % np.uint64(shards)).astype(np.int64), _ASKED, [strings[i] for i in few.tolist()])))
            yield _sharded_batch(list(_dealt_windows(_taken(t, many), [strings[i] for i in many.tolist()], shards)))

    return _with_texts(docs, asked, shards).mapInArrow(run, _SHARDED)


def _windows(t: Columns, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of stretches, and of each of their windows: place in the bytes, hash, document, place
    in the document."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    windows = t["more"].astype(np.int64) + 1
    of = np.repeat(np.arange(len(strings)), windows)
    step = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    lengths = windows + LENGTH - 1
    place = (np.cumsum(lengths) - lengths)[of] + step
    sums = _prefix_hashes(data)
    # equal windows have equal grams, at the same distance
    key = _mixed(_between(sums, place, place + LENGTH) + _mixed(_gram(t)[of] + (t["at"].astype(np.int64)[of] - step).astype(np.uint64)))
    return data, place, key, t["doc"][of], t["lo"].astype(np.int64)[of] + step


def _window_rows(t: Columns, strings: list[bytes]) -> Columns:
    """A row for each window of stretches."""
    data, place, key, doc, lo = _windows(t, strings)
    check = _mixed(_between(_prefix_hashes(data, _BYTE2, _UP2), place, place + LENGTH, _DOWN2)) >> np.uint64(32)
    return {"key": key, "check": check.astype(np.uint32), "doc": doc, "lo": lo.astype(np.uint32)}


def _first_windows(w: Columns) -> tuple[Columns, Columns]:
    """(the first of equal windows, spans of the others)."""
    w = _taken(w, np.lexsort((w["lo"], w["doc"], w["check"], w["key"])))
    first = np.ones(len(w["key"]), bool)
    first[1:] = (w["key"][1:] != w["key"][:-1]) | (w["check"][1:] != w["check"][:-1])
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    repeat = ~first & ((w["doc"] != w["doc"][head]) | (w["lo"] != w["lo"][head]))
    return _taken(w, first), _spans_of_windows(w["doc"][repeat], w["lo"][repeat].astype(np.int64))


def _compared(t: Columns, strings: list[bytes]) -> Columns:
    """Spans of the windows of stretches around common grams that come earlier in another one."""
    data, place, key, doc, lo = _windows(t, strings)
    order = np.lexsort((lo, doc, key))
    key, doc, lo, place = key[order], doc[order], lo[order], place[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    repeat = np.nonzero(~first & ((doc != doc[head]) | (lo != lo[head])))[0]
    views = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    same = [(views[place[x]] == views[place[head[x]]]).all(1) for x in np.array_split(repeat, max(1, len(repeat) // 50_000))]
    repeat = repeat[np.concatenate(same)] if len(repeat) else repeat
    return _spans_of_windows(doc[repeat], lo[repeat])


def _spans_of_windows(doc: np.ndarray, lo: np.ndarray) -> Columns:
    """Maximal spans of windows that follow each other."""
    order = np.lexsort((lo, doc))
    doc, lo = doc[order], lo[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > lo[:-1] + 1)
    starts = np.nonzero(new)[0]
    ends = np.append(starts[1:], len(doc)) - 1 if len(doc) else starts
    return {"doc": doc[starts], "lo": lo[starts].astype(np.uint32), "end": (lo[ends] + LENGTH).astype(np.uint32)}


def _window_repeats(stretches: DataFrame, shards: int) -> DataFrame:
    """Spans of the windows that come earlier in another stretch, by shard of their document."""
    width = sum(np.dtype(kind).itemsize for _, kind in TUPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["shard"]):
            which, kinds = table.column("shard").to_numpy(), table.column("kind").to_numpy()
            rows: list[tuple[int, int, bytes]] = []
            for one in np.unique(which):
                blobs, strings, windows = [], [], []
                for i in np.nonzero(which == one)[0].tolist():
                    packed = table.column("packed")[i].as_py()
                    if kinds[i] == _SPANS:
                        rows.append((int(one), _SPANS, packed))
                        continue
                    if kinds[i] == _WINDOWS:
                        windows.append(packed)
                        continue
                    n = int.from_bytes(packed[:4], "little")
                    at = 4 + n * width
                    blobs.append(packed[4:at])
                    for more in np.frombuffer(blobs[-1][-n:], np.uint8).tolist():
                        strings.append(packed[at : at + more + LENGTH])
                        at += more + LENGTH
                if windows:
                    _, spans = _first_windows(_unpack(windows, WINDOW))
                    rows += _by_shard(spans, SPAN, _shard_of(spans["doc"], shards), _SPANS)
                if not blobs:
                    continue
                spans = _compared(_unpack(blobs, TUPLE), strings)
                rows += _by_shard(spans, SPAN, _shard_of(spans["doc"], shards), _SPANS)
            yield _sharded_batch(rows)

    return _sorted_shards(stretches, shards).mapInArrow(run, _SHARDED)


def _without(data: bytes, lo: np.ndarray, end: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs removed, what is left), for spans sorted by start."""
    if not len(lo):
        return 0, 0, data
    reach = np.maximum.accumulate(end)
    new = np.append(True, lo[1:] > reach[:-1])
    starts, stops = lo[new].tolist(), reach[np.append(np.nonzero(new)[0][1:], len(lo)) - 1].tolist()
    left = [data[a:b] for a, b in zip([0, *stops], [*starts, len(data)], strict=True)]
    return sum(stops) - sum(starts), len(starts), b"".join(left)


def remove_repeats(docs: DataFrame, heads: int = HEADS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, after removal of each
    byte that a string of ``LENGTH`` bytes covers which also starts earlier (in a smaller id, or
    earlier in the same document), judged on the input.

    Null is empty; texts shorter than ``LENGTH`` lose nothing. Rows without an id are left out. Rows
    that repeat an id and text are one document, and each gets its result. For rows that repeat an id with
    other texts the result is undefined, as spans are of ids: such rows need ids of their own. An empty table gives no
    rows; other columns are ignored. heads: different stretches around one gram that one task compares
    (about as many, where they are told from a sample).
    """
    docs = id_and_text(docs).where(F.col("doc_id").isNotNull())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))
    found = durable(_resolved(_suffix_tuples(docs, shards, common_grams(docs, size, heads)), shards, heads))
    more = _window_repeats(_stretches(docs, found.where(F.col("kind") == _ASKED), shards), shards)
    spans = found.where(F.col("kind") == _SPANS).unionByName(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, docs in _streamed(batches, SPAN):
            out = []
            for doc, data in docs:
                a, b = np.searchsorted(cols["doc"], [doc, doc + 1])
                removed, n, left = _without(data, cols["lo"][a:b], cols["end"][a:b])
                out.append((doc, len(data), removed, n, hashlib.sha256(left).hexdigest()))
            c = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_texts(docs, spans, shards).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d)),
x AS (SELECT doc_id, i, i > lag(i, 1, -200) OVER (PARTITION BY doc_id ORDER BY i) + 100 AS new FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
y AS (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM x),
z AS MATERIALIZED (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM y GROUP BY doc_id, run),
p AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS prior FROM z),
q AS (SELECT p.doc_id, count(*) AS n, sum(hi - lo) AS removed, max(hi) AS stop, string_agg(substr(h, 2 * prior + 1, 2 * (lo - prior)), '' ORDER BY lo) AS head FROM p JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN q USING (doc_id)
"""
