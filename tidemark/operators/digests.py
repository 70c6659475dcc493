"""Digests of blocks over their rows in order, in bounded memory.

Rows are brought together by block and sorted by the shuffle, and stream through one MD5 state per block: a
block is one task's, as its digest depends on every row before, but no more of it than a batch is ever held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def block_digests(df: DataFrame, block: Column, text: Column, order: list[str], separator: str = "", name: str = "hash") -> DataFrame:
    """(block, num_rows, digest) of each block: the MD5 in hex of the texts of its rows, in the given order, with a separator
    between. Null texts are left out, as SQL's aggregation of strings does; ties of the order go by the text. Null
    is a block like any other, an empty table gives no rows."""
    rows = df.select(block.alias("block"), text.cast("string").alias("_text"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    dealt = rows.repartition("block").sortWithinPartitions("block", *keys, "_text").select("block", "_text")
    schema = StructType([dealt.schema["block"], StructField("num_rows", LongType()), StructField(name, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, here, state, n, any_text = None, None, None, 0, False

        def out(value: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([value], kind), pa.array([n], pa.int64()), pa.array([state.hexdigest() if any_text else None], pa.string())], names=["block", "num_rows", name])

        for batch in batches:
            kind = batch.schema.field(0).type
            ends = pc.run_end_encode(batch.column(0))
            start = 0
            for end, value in zip(ends.run_ends.to_pylist(), ends.values.to_pylist(), strict=True):
                if state is None or value != here:
                    if state is not None:
                        yield out(here)
                    here, state, n, any_text = value, hashlib.md5(usedforsecurity=False), 0, False
                texts = [t for t in batch.column(1).slice(start, end - start).to_pylist() if t is not None]
                if texts:
                    state.update(((separator if any_text else "") + separator.join(texts)).encode())
                    any_text = True
                n += end - start
                start = end
        if state is not None:
            yield out(here)

    return dealt.mapInArrow(run, schema)
