"""Best-fit packing of token sequences with certified bin counts.

Documents are encoded, closed with one id, and only those longer than a sequence are cut. Pieces
are dealt to partitions by hash, each partition is packed by best-fit decreasing, and lower bounds
from dual-feasible functions certify its number of bins: a partition that meets its bound cannot be
packed better. Partitions above their bound (with a gap) keep the bins that are full, and give the
pieces of the others to the next round, where they meet pieces of other such partitions and are
packed again; so does the emptiest bin of the others. Rounds go on while they save bins and there are
pieces for more than one partition. What moves between rounds is lengths, never text or ids. Each
round's bins and bound are logged, and returned to who asks for them.

A piece of exactly one sequence is a bin of its own and takes no part (its number is negative).
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import kept, loaded, ship
from tidemark.llm.common import durable, id_and_text

CAPACITY = 4096
END_ID = 1
#: Pieces that one partition packs: bounds the memory of a task.
PER_PARTITION = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = "row long, doc_id long, piece int, length long, bin long, offset long, settled boolean, bound long, part long"
_LOG = logging.getLogger(__name__)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document: its ids (and the closing id), cut only beyond ``capacity``.
    Null and empty texts are the closing id alone."""
    shared = ship(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        of = kept(bpe, "ids", lambda w: np.array(bpe.word(w), "<u4").tobytes()).__getitem__
        last = int(end_id).to_bytes(4, "little")
        for batch in batches:
            doc, part, start, length, crc = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = []
                for special, words in bpe.segments(text.as_py()):
                    ids += [int(special).to_bytes(4, "little")] if special is not None else map(of, words)
                whole = b"".join([*ids, last])
                n = len(whole) // 4
                for i, at in enumerate(range(0, n, capacity)):
                    cut = whole[4 * at : 4 * (at + capacity)]
                    doc.append(key), part.append(i), start.append(at), length.append(len(cut) // 4), crc.append(zlib.crc32(cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(part, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return id_and_text(docs).mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The least bins that any packing needs, as far as dual-feasible functions tell.

    A function f on sizes is dual feasible if sizes that fit one bin have images of at most 1 in
    sum; then the sum of images bounds the bins from below. Used are the identity, the steps that
    count sizes above capacity - t as whole and ignore those below t (for every t up to half), and
    the roundings floor((k + 1) x) / k where (k + 1) x is no integer, else x.
    """
    x = np.asarray(lengths, np.int64)
    if not x.size:
        return 0
    counts = np.bincount(x, minlength=capacity + 1)
    sums = counts * np.arange(capacity + 1)
    n_to, s_to = np.cumsum(counts), np.cumsum(sums)
    best = -(-int(sums.sum()) // capacity)
    t = np.arange(0, capacity // 2 + 1)
    large = n_to[capacity] - n_to[capacity - t]  # above capacity - t
    middle = s_to[capacity - t] - np.where(t > 0, s_to[np.maximum(t - 1, 0)], 0)
    best = max(best, int((large + -(-middle // capacity)).max()))
    size = np.arange(capacity + 1)
    for k in range(1, 20):
        top, rest = np.divmod((k + 1) * size, capacity)
        value = np.where(rest == 0, size * k, top * capacity)  # times k * capacity
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each length, and what is left in each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    left: list[int] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is left in them
    some = 0  # bit r is set where bins with r left exist
    for i in order.tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                some &= ~(1 << room)
        else:
            b, room = len(left), capacity
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left[b] = room = room - n
        if room:
            open_at[room].append(b)
            some |= 1 << room
    return bins, offsets, np.array(left, np.int64)


def _pack_group(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Packs one partition, with the bound on its bins. Settled are the full bins, and if the number of bins
    is certified all but the emptiest, whose pieces may still fill gaps elsewhere."""
    group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    lengths = group["length"].to_numpy()
    bins, offsets, left = best_fit(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    settled = left[bins] == 0
    if len(left) <= bound:
        settled |= bins != left.argmax()
    return group.assign(bin=bins, offset=offsets, settled=settled, bound=bound)[["row", "doc_id", "piece", "length", "bin", "offset", "settled", "bound", "part"]]


def _rounds(waiting: DataFrame, capacity: int, per_partition: int, certificates: list[dict[str, int]]) -> DataFrame | None:
    """Packed rows of all rounds with sequence_id. waiting: row, doc_id, piece, length."""
    done, kept, before = None, 0, None
    for r in count():
        n = waiting.count()
        if not n:
            break
        parts = max(1, -(-n // per_partition))
        dealt = waiting.withColumn("part", F.pmod(F.xxhash64(F.col("row"), F.lit(r)), F.lit(parts)))
        packed = durable(dealt.groupBy("part").applyInPandas(lambda group: _pack_group(group, capacity), _PACKED))
        each = packed.groupBy("part").agg((F.max("bin") + 1).alias("bins"), F.first("bound").alias("bound"), F.count_distinct(F.when(F.col("settled"), F.col("bin"))).alias("kept"))
        bins, bound, more = each.agg(F.sum("bins"), F.sum("bound"), F.sum("kept")).first()
        certificates.append({"round": r, "partitions": parts, "bins": bins, "bound": bound, "bins_in_all": kept + bins})
        _LOG.info("%s", certificates[-1])
        # round, partition and bin make the id: 12, 20 and 31 bits
        ids = F.shiftleft(F.lit(r).cast("long"), 51) + F.shiftleft(F.col("part"), 31) + F.col("bin")
        placed = packed.select("row", ids.alias("sequence_id"), "offset", "settled")
        if before is not None and kept + bins >= before[0]:  # nothing is saved: the bins of the round before stay
            done = done.unionByName(before[1].where("NOT settled"))
            break
        settled = placed if parts == 1 else placed.where("settled")
        done = settled if done is None else done.unionByName(settled)
        if parts == 1:
            break
        kept, before = kept + more, (kept + bins, placed)
        waiting = packed.where("NOT settled").select("row", "doc_id", "piece", "length")
    return done if done is None else done.drop("settled")


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, per_partition: int = PER_PARTITION, certificates: list[dict[str, int]] | None = None
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts give one piece of length 1, documents that repeat an id are pieces of
    their own, an empty table gives no rows, other columns are ignored. Ties go by length, id and
    piece number. certificates: gets, for each round, the bins of its partitions and their bound.
    """
    # written once: encoding is not repeated in later rounds
    cut = durable(pieces(docs, vocabulary, capacity, end_id).withColumn("row", F.monotonically_increasing_id()))
    whole = cut.where(F.col("length") == capacity).select(*cut.columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < capacity)
    placed = _rounds(rest.select("row", "doc_id", "piece", "length"), capacity, per_partition, [] if certificates is None else certificates)
    packed = whole if placed is None else whole.unionByName(rest.join(placed, "row").select(*whole.columns))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
