"""Sources: files, JSON-lines logs and JDBC tables."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of a grid that become predicates, one task each.
CELLS = 10_000


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header under a declared schema; an empty field is null."""
    return spark.read.options(nullValue="", timestampNTZFormat="yyyy-MM-dd HH:mm:ss").csv(path, header=True, schema=schema)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a declared schema; malformed lines are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def tail(logs: DataFrame, level: str | None, order: str, n: int) -> DataFrame:
    """The last n log rows, of one level if given, oldest first."""
    chosen = logs.where(F.upper("level") == level.upper()) if level else logs
    return chosen.orderBy(F.desc(order)).limit(n).orderBy(order)


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page of an ordered table. Whole tables are never paged: Spark reads them in partitions."""
    return df.orderBy(*order).offset(offset).limit(limit)


def has_data(df: DataFrame) -> bool:
    return not df.isEmpty()


def read_jdbc(spark: SparkSession, options: dict[str, str], predicates: list[str] | None = None) -> DataFrame:
    """A table of a database, one task per predicate (the bounds of a grid's cells); projections,
    filters and aggregates are pushed down by the source."""
    reader = spark.read.format("jdbc").options(**options)
    if not predicates:
        return reader.load()
    return spark.read.jdbc(options["url"], options["dbtable"], predicates=predicates, properties={k: v for k, v in options.items() if k not in ("url", "dbtable")})


def _sql_literal(value: Any) -> str:
    match value:
        case dt.datetime():
            return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
        case dt.date():
            return f"DATE '{value}'"
        case str():
            return "'" + value.replace("'", "''") + "'"
    return str(value)


def cell_predicates(grid: DataFrame, column: str, nulls: bool = False) -> list[str]:
    """The bounds of a grid's cells (start_, end_) as predicates for ``read_jdbc``, at most ``CELLS``: they go
    through the driver. nulls: one more for rows whose column is null."""
    cells = grid.select("start_", "end_").orderBy("start_").limit(CELLS + 1).collect()
    if len(cells) > CELLS:
        raise ValueError(f"more than {CELLS} cells: take a greater step")
    found = [f"{column} >= {_sql_literal(c.start_)} AND {column} < {_sql_literal(c.end_)}" for c in cells]
    return found + ([f"{column} IS NULL"] if nulls else [])
