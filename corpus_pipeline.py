"""The corpus pipeline: from raw documents to packed token sequences.

Five stages, each of which calls one operator on all rows that its predecessor kept: documents that
the quality classifier rejects go; of exact copies one stays; of near copies one stays; secrets are
replaced in the texts; what is left is encoded and packed. Every stage is written as Parquet and
read again by the next, so a lost executor costs no earlier stage. All stages but the last return
the columns of ``documents``, and whatever other columns there are, under any names. The two dedup stages
decide on rows, not on ids: rows are numbered by their place in their file, so ids may repeat or be null. Every stage turns an empty table into an empty one.
"""

from __future__ import annotations

from itertools import count

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact, minhash, packing, quality, secrets
from tidemark.llm.common import table, unused
from tidemark.llm.queries import VOCABULARY
from tidemark.work import folder, saved

#: Near copies have a similarity of 0.8 or more; the 85 of op3 is of that operator's contract alone.
NEAR_PERCENT = 80


def _numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a unique number of each row, the same whenever they are read, and the name of its column.

    A row of a table that is read whole is told by its place in its file, below a hash of the file's name.
    Hashes are tried until all files have their own: only counts of files reach the driver, and nothing
    is copied. Other rows are numbered and written, as numbers given anew could be others.
    """
    (row,) = unused(docs.columns, "_row")
    if (files := _files(docs)) is None:
        path = folder(spark)
        docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
        return spark.read.parquet(path), row
    bits = max(1, int(files.agg(F.max("last")).first()[0] or 0).bit_length())

    def name(path: str | Column, seed: int) -> Column:
        return F.pmod(F.xxhash64(path, F.lit(seed)), F.lit(1 << (63 - bits)))

    for seed in count():
        n, different = files.agg(F.count("*"), F.count_distinct(name("path", seed))).first()
        if n == different:
            break
    source = docs.metadataColumn("_metadata")
    return docs.withColumn(row, F.shiftleft(name(source["file_path"], seed), bits).bitwiseOR(source["row_index"])), row


def _files(docs: DataFrame) -> DataFrame | None:
    """path and last row of each file of ``docs``; None unless it is all rows of files, each once."""
    try:
        source = docs.metadataColumn("_metadata")
        places = docs.select(source["file_path"].alias("path"), source["row_index"].alias("place"))
    except AnalysisException:
        return None
    files = saved(places.groupBy("path").agg(F.max("place").alias("last"), F.count("*").alias("n")))
    return files if files.where("n <> last + 1").isEmpty() else None


def _only(numbered: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """The rows of ``numbered`` whose number is in the one column of ``kept``, without their number."""
    (name,) = unused(numbered.columns, "_kept")
    return numbered.join(kept.toDF(name), F.col(row) == F.col(name), "left_semi").drop(row)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is learned from the labelled documents of the input tables, and applied to ``docs``: rows
    with a score of 0.3 or more stay as they are. Null and empty texts have the score of a text without
    features, which is the share of good ones among the labels, by and large; repeated rows share their
    fate, and rows without an id are judged like all others."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts (white space apart, null as empty) exactly one row stays: the longest
    original, then the smallest id (null after all others), then any of them. Rows that repeat an id and
    text are copies too; rows that share only their id are apart."""
    rows, row = _numbered(spark, docs)
    return _only(rows, row, exact.exact_groups(rows, row_col=row).where("kept").select("row"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies exactly one row stays: the one with the smallest id (null after all
    others), of equals any. Rows that repeat or lack an id are linked like any other; texts without words,
    null and empty ones among them, are near copies of nothing and stay."""
    rows, row = _numbered(spark, docs)
    classes = minhash.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), percent=NEAR_PERCENT)
    ids = rows.select(F.col(row).alias("row"), "doc_id")
    named = classes.select(F.col("doc_id").alias("row"), "component_id").join(ids, "row")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    return _only(rows, row, named.groupBy("component_id").agg(best.alias("best")).select("best.row"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; secrets in its text are replaced by a mark, overlapping ones by one. Null and empty
    texts stay as they are, repeated rows repeat."""
    return secrets.redact(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and its place there. Null and empty texts are a piece
    of one token; rows that repeat or lack an id are pieces of their own; ties go by length, id and piece."""
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup),
    ("minhash near-dedup", near_dedup),
    ("secret scans", secret_redaction),
    ("best-fit packing", packed_sequences),
]

#: Learned scores and token ids are beyond SQL; tests hold each stage, and run(), against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with what is between them in the folder of checkpoints."""
    base = folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
