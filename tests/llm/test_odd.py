"""Rows that repeat or lack an id, clashing names and empty tables, for every operator; queries against their SQL."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest

from tests.oracle import connect, spark_rows, sql_rows
from tidemark.llm import bpe, embeddings, exact, minhash, packing, pii, quality, queries, secrets, substrings, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
LINE = "one two three four five six seven eight nine ten token=abcdefghijklmnop john@example.com"
ROWS = [(1, LINE), (1, LINE), (1, "another text"), (None, LINE), (None, LINE), (None, None), (2, LINE + " more"), (2, ""), (3, None), (-4, LINE * 40), (2**62, LINE * 40)]
CLASHING = "doc_id long, text string, row int, bin string, part string, settled int, bound string, digest int, value string, family int, `component.id` string, score int, held_out string, shard int, kind string, missing int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "b", "p", 0, "x", 5, "v", 6, "c", 7, "h", 8, "k", 9) for i, t in ROWS], CLASHING).repartition(3)


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, 7), (1, 1, 0)], "doc_id long, quality int, toxic int")


def test_a_row_each(spark, odd, plain, labels):
    """Operators on single texts give each row its result, whatever its id and the names of other columns."""
    operators = {
        "op2": lambda d: bpe.round_trip(d, PATH), "op4": lambda d: quality.quality_scores(d, labels), "op5": lambda d: toxicity.toxicity_scores(d, labels),
        "op6": pii.personal_data, "op8": secrets.secret_report, "op9": exact.exact_groups,
    }
    for name, run in operators.items():
        got = run(odd)
        assert spark_rows(got) == spark_rows(run(plain)), name
        assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(i) for i, _ in ROWS), name
        assert run(plain.where("doc_id = 99")).isEmpty(), name


def test_pieces_of_repeated_rows(odd, plain):
    got = packing.pack(odd, PATH).collect()
    assert sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in got) == sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in packing.pack(plain, PATH).collect())
    assert sum(r.piece == 0 for r in got) == len(ROWS) and len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_links_of_repeated_ids(odd, plain):
    """Rows without an id take part in no links; rows that repeat one are one document, or vectors of their own."""
    with_id = sorted(i for i, _ in ROWS if i is not None)
    for run in (minhash.near_duplicates, substrings.remove_repeats):
        assert sorted(r.doc_id for r in run(odd).collect()) == with_id
        assert run(plain.where("doc_id = 99")).isEmpty()
    near = {r.doc_id: r.component_id for r in minhash.near_duplicates(plain.where("doc_id <> 1")).collect()}
    assert near[2**62] == near[-4] == -4


def test_vectors_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], "a", 1), (1, [1.0, 0.01], "a", 2), (1, [1.0, 0.0], "a", 3), (None, [1.0, 0.0], "a", 4), (2, [0.0, 1.0], "a", 5), (0, [0.9, 0.0], "b", 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, weight int")
    got = sorted(map(tuple, embeddings.near_duplicates(frame.withColumnRenamed("weight", "same")).collect()))
    assert got == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, sf_dir, name):
    assert spark_rows(queries.queries()[name](spark, sf_dir)) == sql_rows(connect(sf_dir), queries.oracle_sql()[name])


def test_digests_of_a_text_without_finds(spark):
    (row,) = pii.personal_data(spark.createDataFrame([(1, "nothing")], "doc_id long, text string")).collect()
    assert (row.spans, row.n_spans, row.base_sha256) == ("", 0, hashlib.sha256(b"").hexdigest())
