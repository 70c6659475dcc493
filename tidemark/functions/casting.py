"""Casts to the universal types: nulls pass, what cannot be cast is null, nothing raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Universal type to Spark type. Times of day are text, as Spark's own type is off by default.
TYPES = {
    "integer": "int", "bigint": "bigint", "smallint": "smallint", "float": "float", "double": "double", "decimal": "decimal(38,18)",
    "varchar": "string", "text": "string", "char": "string", "date": "date", "time": "string", "timestamp": "timestamp_ntz",
    "datetime": "timestamp_ntz", "boolean": "boolean", "blob": "binary", "binary": "binary", "json": "string",
    "uuid": "string", "uuid_text": "string", "uuid_text_dash": "string",
}
#: Words for true and false, and formats of times, tried in order.
TRUE, FALSE = ("true", "1", "yes", "on"), ("false", "0", "no", "off")
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS")
DATETIME_FORMATS = (*TIMESTAMP_FORMATS, "yyyy-MM-dd")
_ZONE = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"
_NUMBER = r"^[+-]?[0-9]+(\.[0-9]+)?$"


def _time(text: str, formats: tuple[str, ...]) -> str:
    bare = f"regexp_replace(regexp_replace({text}, r'(:[0-9]{{2}}(\\.[0-9]+)?){_ZONE}', '$1'), r'^(.{{10}})T', '$1T')"
    tried = [f"CAST(try_to_timestamp({bare}, \"{f}\") AS TIMESTAMP_NTZ)" for f in formats]
    epoch = f"CASE WHEN {text} RLIKE r'{_NUMBER}' THEN TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, try_cast({text} AS DECIMAL(18,6))) END"
    return f"coalesce({', '.join(tried)}, {epoch})"


def cast_sql(column: str, kind: str, precision: tuple[int, int] | None = None) -> str:
    """SQL that casts a column to a universal type."""
    text = f"trim(CAST({column} AS STRING))"
    match kind:
        case "integer" | "bigint" | "smallint":
            # as fractions are cut off, through a decimal wide enough for any of them
            return f"try_cast(try_cast({text} AS DECIMAL(38,10)) AS {TYPES[kind]})"
        case "float" | "double":
            return f"try_cast({text} AS {TYPES[kind]})"
        case "decimal":
            p, s = precision or (38, 18)
            return f"try_cast({text} AS DECIMAL({p},{s}))"
        case "varchar" | "text" | "char":
            return f"CAST({column} AS STRING)"
        case "date":
            return f"CASE WHEN {text} RLIKE r'^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}' THEN try_cast(left({text}, 10) AS DATE) END"
        case "time":
            return f"CASE WHEN {text} RLIKE r'^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$' THEN {text} END"
        case "timestamp":
            return _time(text, TIMESTAMP_FORMATS)
        case "datetime":
            return _time(text, DATETIME_FORMATS)
        case "boolean":
            words = {True: TRUE, False: FALSE}
            return "CASE " + " ".join(f"WHEN lower({text}) IN ({', '.join(repr(w) for w in ws)}) THEN {str(v).lower()}" for v, ws in words.items()) + " END"
        case "blob" | "binary":
            return f"encode(CAST({column} AS STRING), 'utf-8')"
        case "json":
            return f"CASE WHEN try_parse_json(CAST({column} AS STRING)) IS NOT NULL THEN CAST({column} AS STRING) END"
        case "uuid" | "uuid_text" | "uuid_text_dash":
            bare = f"lower(regexp_replace({text}, '[-{{}}]', ''))"
            dashed = f"concat_ws('-', substr({bare}, 1, 8), substr({bare}, 9, 4), substr({bare}, 13, 4), substr({bare}, 17, 4), substr({bare}, 21, 12))"
            return f"CASE WHEN {bare} RLIKE '^[0-9a-f]{{32}}$' THEN {bare if kind == 'uuid_text' else dashed} END"
    raise ValueError(f"unknown type: {kind}")


def cast(column: str, kind: str, precision: tuple[int, int] | None = None) -> Column:
    return F.expr(cast_sql(column, kind, precision))


def cast_to_schema(df: DataFrame, schema: dict[str, str], errors: str = "_cast_errors") -> DataFrame:
    """Every column of ``schema`` cast; other columns as they are; names of columns whose value was
    there and could not be cast in ``errors``."""
    casts = {c: cast(c, kind) for c, kind in schema.items() if c in df.columns}
    failed = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & v.isNull(), F.lit(c)) for c, v in casts.items()]))
    return df.select(*[casts[c].alias(c) if c in casts else F.col(c) for c in df.columns], failed.alias(errors))
