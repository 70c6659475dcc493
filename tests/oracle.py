"""Compares a query with its SQL, without regard to order."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pandas as pd
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(v: object) -> object:
    match v:
        case None | bool() | int() | str():
            return v
        case float() | decimal.Decimal():
            return None if math.isnan(v) else round(float(v), 6)
        case datetime.datetime() | datetime.date():
            return str(pd.Timestamp(v))
    return v


def rows(columns: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(sorted(columns))] + sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def spark_rows(df: DataFrame) -> list[tuple]:
    return rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(c: duckdb.DuckDBPyConnection, sql: str) -> list[tuple]:
    found = c.sql(sql)
    return rows(found.columns, found.fetchall())
