"""Specifications of columns, dimensions and tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of time dimensions.
UNITS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")


@dataclass(frozen=True)
class ColumnSpec:
    """A column computed as ``expr`` (its name if none). Virtual columns are never fetched, hashed or
    inserted; ``hashed`` columns decide whether a row changed; ``order`` is asc or desc."""

    name: str
    expr: str | None = None
    data_type: str | None = None
    hashed: bool = True
    key: bool = False
    order: str | None = None
    virtual: bool = False
    nullable: bool = True

    def column(self) -> Column:
        return F.expr(self.expr or self.name).alias(self.name)


@dataclass(frozen=True)
class Dimension:
    """One dimension of a partitioning. kind: int, datetime, date, hex or value; unit for times."""

    column: str
    step: int = 1
    kind: str = "int"
    unit: str = "day"
    offset: int = 0

    def __post_init__(self) -> None:
        if self.kind not in ("int", "datetime", "date", "hex", "value"):
            raise ValueError(f"unknown kind of dimension: {self.kind}")
        if self.unit not in UNITS:
            raise ValueError(f"unknown unit: {self.unit}")
        if self.step < 1 and not (self.kind == "value" and self.step == -1):
            raise ValueError("a step is positive; -1 puts all values in one chunk")


@dataclass(frozen=True)
class TableSpec:
    """The columns of a table, and filters that hold for all that reads it."""

    columns: tuple[ColumnSpec, ...]
    filters: tuple[str, ...] = field(default=())

    def fetch(self, df: DataFrame) -> DataFrame:
        """The declared columns that are not virtual, under the static filters."""
        for condition in self.filters:
            df = df.where(condition)
        return df.select(*[c.column() for c in self.columns if not c.virtual])

    @property
    def keys(self) -> list[str]:
        return [c.name for c in self.columns if c.key]

    @property
    def hashed(self) -> list[str]:
        """Columns of the row hash, in alphabetical order."""
        return sorted(c.name for c in self.columns if c.hashed and not c.virtual)

    @property
    def ordering(self) -> list[Column]:
        chosen = [c for c in self.columns if c.order]
        return [F.col(c.name).desc() if c.order == "desc" else F.col(c.name).asc() for c in chosen]

    def renamed(self, df: DataFrame, names: dict[str, str]) -> DataFrame:
        """The fetched columns under the names of the destination."""
        return df.select(*[F.col(c.name).alias(names.get(c.name, c.name)) for c in self.columns if not c.virtual])
