"""Every registered query of the engine against its SQL."""

from __future__ import annotations

import pytest

from tests.oracle import connect, spark_rows, sql_rows
from tidemark.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def oracle(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, oracle, name):
    got = spark_rows(QUERIES[name](spark, sf_dir))
    assert len(got) > 1 or name in ("sync_agg_hash",)
    if name in ORACLES:
        assert got == sql_rows(oracle, ORACLES[name])


def test_stream_upsert_gives_the_last_rows(spark, sf_dir):
    assert spark_rows(QUERIES["stream_upsert"](spark, sf_dir)) == spark_rows(QUERIES["dedup_last"](spark, sf_dir))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
