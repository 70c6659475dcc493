"""Aggregates of groups that are kept up to date by changes instead of by their rows.

Counts, sums and sums of row hashes change by the signed rows of a set of changes: new rows count once, the
rows that they replace count minus once. A least or greatest value changes with them too, unless a row that had
it is gone and no new row is as extreme: only such groups are read again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import block_hash, row_hash_int
from tidemark.plans.bounds import extremes
from tidemark.work import saved

#: Values of a key that are listed in a filter.
LISTED = 1000


@dataclass(frozen=True)
class Measure:
    """kind: sum, min or max of an SQL expression; the number of its values that are not null is kept beside a
    sum, so that a sum of nothing is null."""

    kind: str
    expr: str

    def __post_init__(self) -> None:
        if self.kind not in ("sum", "min", "max"):
            raise ValueError(f"not a measure that changes can keep: {self.kind}")


@dataclass(frozen=True)
class Groups:
    """Groups by computed keys (SQL) with the number of their rows, measures, and the sum of the row hashes of
    ``hashed``, if any."""

    keys: dict[str, str]
    measures: dict[str, Measure]
    hashed: tuple[str, ...] = ()
    count: str = "num_rows"
    checksum: str = "checksum"

    def _rows(self, df: DataFrame) -> DataFrame:
        """Keys, values of measures, and the row's hash."""
        values = [F.expr(m.expr).alias(f"_v_{n}") for n, m in self.measures.items()]
        return df.select(*[F.expr(e).alias(n) for n, e in self.keys.items()], *values, *([row_hash_int([*self.hashed]).alias("_h")] if self.hashed else []))

    def of(self, df: DataFrame) -> DataFrame:
        """The groups of all rows."""
        out = [F.count("*").alias(self.count)]
        for n, m in self.measures.items():
            out.append({"sum": F.sum, "min": F.min, "max": F.max}[m.kind](f"_v_{n}").alias(n))
            if m.kind == "sum":
                out.append(F.count(f"_v_{n}").alias(f"{n}__n"))
        return self._rows(df).groupBy(*self.keys).agg(*out, *([block_hash("_h").alias(self.checksum)] if self.hashed else []))

    def signed(self, changes: DataFrame) -> DataFrame:
        """Per group that changes touch, what they add to it: from rows with change_type and, as old__, the row that
        each replaces or deletes."""
        columns = [c for c in changes.columns if c not in ("change_type", "old__")]
        new = self._rows(changes.where("change_type IN ('A', 'M')").select(*columns)).withColumn("_s", F.lit(1))
        old = self._rows(changes.where("change_type IN ('M', 'D')").select("old__.*")).withColumn("_s", F.lit(-1))
        plus = F.col("_s") > 0
        out = [F.sum("_s").cast("long").alias("_n")]
        for n, m in self.measures.items():
            v = F.col(f"_v_{n}")
            if m.kind == "sum":
                out += [F.sum(F.when(plus, v).otherwise(-v)).alias(f"_d_{n}"), F.coalesce(F.sum(F.when(v.isNotNull(), F.col("_s"))), F.lit(0)).cast("long").alias(f"_c_{n}")]
            else:
                f = F.min if m.kind == "min" else F.max
                out += [f(F.when(plus, v)).alias(f"_in_{n}"), f(F.when(~plus, v)).alias(f"_out_{n}")]
        both = new.unionByName(old)
        if self.hashed:
            both = both.withColumns({"_hp": F.when(plus, F.col("_h")), "_hm": F.when(~plus, F.col("_h"))})
            out += [block_hash("_hp").alias("_hp"), block_hash("_hm").alias("_hm")]
        return both.groupBy(*self.keys).agg(*out)


def merged(stored: DataFrame, changes: DataFrame, rows: DataFrame, groups: Groups) -> DataFrame:
    """The groups that changes touch, as they are afterwards, with change_type: A, M, or D for those without rows.
    ``stored`` holds the groups before; ``changes`` are rows with change_type and old__, as
    ``row_diff(..., old=True)`` gives them; ``rows`` is the table after the changes, of which only the rows of groups
    that lost their least or greatest value are read, by ranges of their keys. Null keys are a group like
    any other. ``stored`` is read once, and only met groups come out."""
    keys = [*groups.keys]
    delta = groups.signed(changes)
    same = reduce(and_, [F.col(f"o.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys])
    both = delta.alias("d").join(stored.withColumn("_there", F.lit(True)).alias("o"), same, "left")
    n = F.coalesce(F.col(f"o.{groups.count}"), F.lit(0)) + F.col("d._n")
    out, lost = [n.alias(groups.count)], [F.lit(False)]
    for name, m in groups.measures.items():
        was = F.col(f"o.{name}")
        if m.kind == "sum":
            values = F.coalesce(F.col(f"o.{name}__n"), F.lit(0)) + F.col(f"d._c_{name}")
            kind = stored.schema[name].dataType
            total = (F.coalesce(was, F.lit(0).cast(kind)) + F.coalesce(F.col(f"d._d_{name}"), F.lit(0).cast(kind))).cast(kind)
            out += [F.when(values > 0, total).alias(name), values.alias(f"{name}__n")]
        else:
            entered, left = F.col(f"d._in_{name}"), F.col(f"d._out_{name}")
            beyond = (lambda a, b: a <= b) if m.kind == "min" else (lambda a, b: a >= b)
            best = (F.least if m.kind == "min" else F.greatest)(was, entered)
            # a row that had the value, or one that the stored groups do not know of, is gone, and none as extreme has come
            gone = left.isNotNull() & F.coalesce(beyond(left, was), F.lit(True)) & ~F.coalesce(beyond(entered, was), F.lit(False))
            out.append(best.alias(name))
            lost.append(gone)
    if groups.hashed:
        whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(20,0)")
        total = whole(f"o.{groups.checksum}") + whole("d._hp") - whole("d._hm")
        out.append(F.pmod(total, F.lit(1 << 62).cast("decimal(20,0)") * F.lit(2).cast("decimal(1,0)")).cast("long").alias(groups.checksum))
    kind = F.when(n == 0, "D").when(F.col("o._there").isNull(), "A").otherwise("M")
    found = saved(both.select(*[F.col(f"d.{k}").alias(k) for k in keys], *out, kind.alias("change_type"), (reduce(or_, lost) & (n > 0)).alias("_lost")).where(~((F.col("change_type") == "D") & F.col("o._there").isNull())))
    settled = found.where("NOT _lost").drop("_lost")
    again = found.where("_lost").select(*keys, "change_type")
    if again.isEmpty():
        return settled
    reread = groups.of(rows_of_groups(rows, again, groups.keys))
    tagged = reread.alias("r").join(again.alias("a"), reduce(and_, [F.col(f"r.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]))
    return settled.unionByName(tagged.select("r.*", "a.change_type"))


def rows_of_groups(rows: DataFrame, groups: DataFrame, keys: dict[str, str]) -> DataFrame:
    """The rows of some groups (key columns). What can be told of the columns that keys are computed from, values
    if they are few and else the least and greatest, reaches the scan; a semi-join does the rest."""
    pruned = rows
    for name, e in keys.items():
        pruned = pruned.where(_bounds(groups, name, e, rows.columns))
    named = {f"_g_{n}": F.expr(e) for n, e in keys.items()}
    keyed = pruned.withColumns(named)
    same = reduce(and_, [keyed[f"_g_{n}"].eqNullSafe(groups[n]) for n in keys])
    return keyed.join(groups, same, "left_semi").drop(*named)


def _bounds(groups: DataFrame, name: str, e: str, columns: list[str]) -> Column:
    """A condition on the column that a key is, or is the date of, which all rows of the groups meet."""
    date = re.fullmatch(r"CAST\((\w+) AS DATE\)", e, re.I)
    if (column := date[1] if date else e) not in columns:
        return F.lit(True)
    missing = F.lit(True) if not groups.where(F.col(name).isNull()).isEmpty() else F.lit(False)
    if not date:
        few = [r[0] for r in groups.select(name).where(F.col(name).isNotNull()).distinct().limit(LISTED + 1).collect()]
        if len(few) <= LISTED:
            return F.col(column).isin(few) | (F.col(column).isNull() & missing)
    limits = extremes(groups, name)
    if limits is None:
        return F.col(column).isNull()
    low, high = limits
    within = (F.col(column) >= low) & ((F.col(column) < F.date_add(high, 1)) if date else (F.col(column) <= high))
    return within | (F.col(column).isNull() & missing)
