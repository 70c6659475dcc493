"""Row, block and group hashes as Column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL = "\\N"
METHODS = ("int", "md5")


def row_text(columns: list[str], separator: str = "|", null: str = NULL) -> Column:
    """The text that is hashed: columns in the given order, nulls marked, so that neither moved
    separators nor nulls and empty strings collide."""
    return F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in columns])


def row_hash(columns: list[str], compatible: bool = False) -> Column:
    """MD5 of a row in hex, over alphabetical columns. compatible: without separator and with nulls as
    empty strings, as stored hashes of other tools may be."""
    ordered = sorted(columns)
    return F.md5(row_text(ordered, "", "") if compatible else row_text(ordered))


def row_hash_int(columns: list[str], digits: int = 8, compatible: bool = False) -> Column:
    """The first hex digits of the row's MD5 as a number."""
    return F.conv(F.substring(row_hash(columns, compatible), 1, digits), 16, 10).cast("long")


def _sum(column: str) -> Column:
    """The sum of non-negative longs modulo 2^63: two sums of 30 and 33 bits, which no number of rows that
    a table can have overflows, put together once per group."""
    low, high = F.sum(F.col(column).bitwiseAND(F.lit((1 << 30) - 1).cast("long"))), F.sum(F.shiftright(column, 30))
    whole = high.cast("decimal(20,0)") * F.lit(1 << 30).cast("decimal(10,0)") + low.cast("decimal(20,0)")
    return F.pmod(whole, F.lit(Decimal(1 << 63))).cast("long")


def block_hash(row_hash_column: str, method: str = "int", order: list[str] | None = None) -> Column:
    """Aggregate over a block. int: the sum of integer row hashes (modulo 2^63), which any order and any
    partial sums give alike. md5: a digest over the rows in order; its memory grows with the block."""
    if method == "int":
        return _sum(row_hash_column)
    if method == "md5" and order:
        return F.expr(f"md5(listagg(left({row_hash_column}, 8), '') WITHIN GROUP (ORDER BY {', '.join(order)}))")
    raise ValueError("a block hash is int, or md5 with an order")


def group_hash(row_hash_column: str, method: str = "int") -> Column:
    """Aggregate over the raw rows of a group; only sums of integer hashes are defined."""
    if method != "int":
        raise ValueError("a group hash is a sum of integer row hashes")
    return _sum(row_hash_column)


def piped_block_hash(columns: list[str], keys: list[str]) -> Column:
    """MD5 of the rows' piped texts, joined by pipes in the order of their keys."""
    parts = ", ".join(f"coalesce(CAST({c} AS STRING), '')" for c in columns)
    return F.expr(f"md5(listagg(concat_ws('|', {parts}), '|') WITHIN GROUP (ORDER BY {', '.join(keys)}))")
