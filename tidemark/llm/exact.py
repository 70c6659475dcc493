"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations only.

Every input partition is a run: its rows are reduced to one record per digest (best row, group
size). Runs then meet in rounds of ``fan`` neighbours (fan 2 is the binomial exchange; a larger
fan merges more ways a round and needs fewer rounds): run r goes to group r div fan, equal digests
of the group merge, and the smallest verified identifier of the longest text survives at every
level. A record is verified by an independent second hash of the same text in the merge key, so
texts whose SHA-256 collided would stay apart.

A group of copies of any size is one record per run before anything moves, and winners go back
down by (digest) to the runs and by (run, digest) to the rows: no task gets more of a hot group
than one input partition holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE, durable, text_of

KEY = ["digest", "check"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One small record per row: the run it is in, digests of its text without white space,
    its length in code points, and the row's unique key if it has one."""
    text = text_of(text_col)
    bare = F.translate(text, WHITE, "")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2(bare, 256)).alias("digest"),
        F.xxhash64(bare).alias("check"),
        F.length(text).alias("n_points"),
        *([F.col(row_col).alias("row")] if row_col else []),
    )


def _merged(records: DataFrame, group: list[str]) -> DataFrame:
    return records.groupBy(*group, *KEY).agg(F.min("best").alias("best"), F.sum("size").alias("size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = 16, row_col: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; of equals, the longest original stays,
    then the smallest id (a null id counts as larger than any other). Null and empty texts are equal. Rows that repeat the kept id
    and text are all marked kept. An empty table gives no rows; other columns are ignored.

    row_col: a column that is unique and never null. It comes first in the result, as row, and settles
    what is left of ties, so that exactly one row of each group is kept.
    """
    rows = durable(digests(docs, id_col, text_col, row_col))
    unique = ["row"] if row_col else []
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    # negated, so that the minimum is the longest text and then the smallest id
    best = F.struct((-F.col("n_points")).alias("minus"), F.col("doc_id").isNull().alias("no_id"), "doc_id", *unique).alias("best")
    leaves = _merged(rows.select("run", *KEY, best, F.lit(1).cast("long").alias("size")), ["run"])
    level = leaves
    while runs > 1:
        level = _merged(level.withColumn("run", F.expr(f"run div {fan}")), ["run"])
        runs = -(-runs // fan)
    winners = level.select(*KEY, F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), *(F.col(f"best.{c}").alias("keep_row") for c in unique))
    by_run = leaves.select("run", *KEY).join(winners, KEY)
    return rows.join(by_run, ["run", *KEY]).select(
        *unique,
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row") if row_col else F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
), g AS (
  SELECT doc_id, bare, first_value(doc_id) OVER (PARTITION BY bare ORDER BY length(t) DESC, doc_id) AS keep_id,
         CAST(count(*) OVER (PARTITION BY bare) AS BIGINT) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM g
"""
