"""Schema drift and evolution of a destination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whole numbers by their digits in decimal, and the bits that they need.
_WHOLE = {"tinyint": (3, 7), "smallint": (5, 15), "int": (10, 31), "bigint": (19, 63)}
#: Bits up to which every whole number has a value of its own.
_REAL = {"float": 24, "double": 53}


def _digits(t: T.DataType) -> tuple[int, int] | None:
    """Digits before and after the point of an exact number."""
    if isinstance(t, T.DecimalType):
        return t.precision - t.scale, t.scale
    return (_WHOLE[name][0], 0) if (name := t.simpleString()) in _WHOLE else None


def holds(a: T.DataType, b: T.DataType) -> bool | None:
    """Whether every value of number type ``a`` has an equal one in ``b``; None if either is no number."""
    x, y = a.simpleString(), b.simpleString()
    exact, other = _digits(a), _digits(b)
    if (exact is None and x not in _REAL) or (other is None and y not in _REAL):
        return None
    if x in _REAL:
        return y in _REAL and _REAL[x] <= _REAL[y]
    if y in _REAL:  # tenths have no binary value; whole numbers have up to some size
        return exact[1] == 0 and (_WHOLE[x][1] if x in _WHOLE else int(exact[0] * 3.33) + 1) <= _REAL[y]
    if x in _WHOLE and y in _WHOLE:
        return _WHOLE[x] <= _WHOLE[y]
    if y in _WHOLE:  # all numbers of so many digits, the greatest of which is above that of the type's own
        return exact[1] == 0 and exact[0] < other[0]
    return exact[0] <= other[0] and exact[1] <= other[1]


def common(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The least number type that holds both; None if none does, or if either is no number."""
    if holds(a, b) is None:
        return None
    x, y = _digits(a), _digits(b)
    candidates: list[T.DataType] = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
    if x and y and (whole := max(x[0], y[0])) + (after := max(x[1], y[1])) <= 38:
        candidates.append(T.DecimalType(whole + after, after))
    candidates += [T.FloatType(), T.DoubleType()]
    return next((c for c in [a, b, *candidates] if holds(a, c) and holds(b, c)), None)


def _base(t: T.DataType) -> str:
    """The type without length, precision and scale."""
    return t.simpleString().split("(")[0].replace("varchar", "string").replace("char", "string")


def drift(existing: T.StructType, desired: T.StructType) -> dict[str, list[str]]:
    """Columns to add, and columns whose base type changed; columns that are gone are kept."""
    have = {f.name: f.dataType for f in existing}
    return {
        "add": [f.name for f in desired if f.name not in have],
        "change": [f.name for f in desired if f.name in have and _base(have[f.name]) != _base(f.dataType)],
    }


def evolve(df: DataFrame, desired: T.StructType, lift: bool = False) -> DataFrame:
    """The data under the evolved schema: new columns null, changed ones cast, others kept. A change to a
    number type that does not hold every value of the old one is refused; with ``lift`` the column gets the least
    type that holds both instead, and only what has none is refused."""
    have, wanted = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in desired}
    found = drift(df.schema, desired)
    # decimals differ by their digits too
    changed = [c for c in have if c in wanted and (c in found["change"] or holds(have[c], wanted[c]) is False)]
    for name in changed:
        if holds(have[name], wanted[name]) is False:
            if not lift or (both := common(have[name], wanted[name])) is None:
                raise ValueError(f"{name}: {have[name].simpleString()} does not fit {wanted[name].simpleString()}")
            wanted[name] = both
    wider = [c for c in have if c in wanted and have[c] != wanted[c] and holds(have[c], wanted[c])]
    cast = df.select(*[F.col(c).cast(wanted[c]).alias(c) if c in {*changed, *wider} else F.col(c) for c in df.columns])
    return cast.select("*", *[F.lit(None).cast(wanted[c]).alias(c) for c in found["add"]])
