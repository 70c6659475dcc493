r"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its text. The ledger tells which rule
versions have been run on a blob and what each of them found. A scan takes the blobs that lack one
of the rule versions, reads each such text once whatever the number of paths and versions that have
it, and runs only the rules that it lacks. A report joins findings, those of the ledger and the new
ones, back to all paths, and shows those of the rule versions asked for: a rule that is raised,
removed or set back needs no change of the ledger.

The ledger is appended to and never rewritten, so a scan that is repeated after a failure does no
harm: equal rows count once.

Positions come from built-in functions: a rule's matches and the pieces between them
(``regexp_extract_all`` and ``split`` walk the same leftmost, non-overlapping matches), whose
lengths add up to starts and ends in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import spread_join, text_of, unused


@dataclass(frozen=True)
class Rule:
    """pattern: every match whose group ``group`` has ``least`` characters or more is a finding;
    shorter matches are dropped, not retried. Raise the version when any of it changes."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1
    base: bool = True
    #: What a text must hold for the pattern to be looked for at all; the pattern itself if empty.
    seen: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed by the contract, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16, seen=r"[0-9a-f]{16}"),
)
#: Public formats beyond the base kinds.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, base=False),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, base=False),
    # other words are matched as a whole, without the group, so that a token begins where a word does
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)|[A-Za-z0-9_-]+", 1, 30, version=2, base=False, seen=r"\.eyJ[A-Za-z0-9_-]"),
)
RULES = BASE_RULES + MORE_RULES
#: One row per blob and scan: the rules (kind@version) that were run, and what they found.
LEDGER = "blob string, rules array<string>, findings array<struct<start:int,end:int,rule:string>>"
_NONE = "cast(array() as array<struct<start:int,end:int,rule:string>>)"
_NONES = "cast(array() as array<array<struct<start:int,end:int,rule:string>>>)"


def _sql(text: str) -> str:
    return "r'" + text.replace("'", "\\x27") + "'"


#: Elements that are gathered in one array before arrays are put together: what a fold has gathered is copied at each
#: step, so gathering n in blocks costs n times this, and not n squared.
_BLOCK = 256


def _let(value: str, name: str, then: str) -> str:
    """SQL of ``then``, in which ``name`` is a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _in_blocks(array: str, state: str, then: str) -> str:
    """SQL that folds over blocks of an array: ``then`` is the state after the block q, from the state o."""
    block = _let(f"slice(whole, CAST(k AS INT) * {_BLOCK} + 1, {_BLOCK})", "q", then)
    return _let(array, "whole", f"aggregate(sequence(0, (size(whole) - 1) div {_BLOCK}), {state}, (o, k) -> {block})")


def _findings(rule: Rule) -> str:
    """SQL for the findings of one rule in ``text``."""
    pattern = _sql(rule.pattern)
    parts = f"arrays_zip(regexp_extract_all(text, {pattern}, 0), regexp_extract_all(text, {pattern}, {rule.group}), split(text, {pattern}, -1))"
    parts = f"transform(filter({parts}, x -> x['0'] IS NOT NULL), x -> struct(length(x['2']) AS p, length(x['0']) AS m, length(x['1']) AS g))"
    found = f"struct(a.at + x.p AS start, a.at + x.p + x.m AS end, '{rule.name}' AS rule)"
    each = f"struct(a.at + x.p + x.m AS at, if(x.g >= {rule.least}, concat(a.found, array({found})), a.found) AS found)"
    block = _let(f"aggregate(q, struct(o.at AS at, {_NONE} AS found), (a, x) -> {each})", "r", "struct(r.at AS at, concat(o.found, array(r.found)) AS found)")
    spans = f"flatten({_in_blocks(parts, f'struct(0 AS at, {_NONES} AS found)', block)}.found)"
    return f"CASE WHEN array_contains(missing, '{rule.name}') AND text RLIKE {_sql(rule.seen or rule.pattern)} THEN {spans} ELSE {_NONE} END"


def versions_of(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(path_col).alias("path"), text.alias("text"), F.sha2(text, 256).alias("blob"))


def _names(rules: tuple[Rule, ...]) -> Column:
    return F.array(*[F.lit(r.name) for r in rules])


def _todo(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, carrier, missing): blobs that lack rule versions, and a path whose text is read for each."""
    carriers = versions.groupBy("blob").agg(F.min("path").alias("carrier"))
    if ledger is None:
        return carriers.withColumn("missing", _names(rules))
    ran = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("ran"))
    had = F.coalesce("ran", F.expr("cast(array() as array<string>)"))
    return carriers.join(ran, "blob", "left").select("blob", "carrier", F.array_except(_names(rules), had).alias("missing")).where(F.size("missing") > 0)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows for the ledger: each blob of ``versions`` that lacks a rule version, with the rules it lacked
    and what they found. Other blobs are not read again and not returned. Rows that repeat a path
    and text are read once; an empty table gives no rows."""
    todo = _todo(versions, ledger, rules)
    texts = versions.alias("v").join(
        todo.alias("t"), (F.col("v.blob") == F.col("t.blob")) & F.col("v.path").eqNullSafe(F.col("t.carrier"))
    ).select("t.blob", "v.text", "t.missing")
    found = F.expr(f"concat({', '.join(map(_findings, rules))})")
    return texts.select("blob", F.col("missing").alias("rules"), found.alias("findings")).dropDuplicates(["blob"])


def merged(ledger: DataFrame | None, new: DataFrame) -> DataFrame:
    """The ledger with a scan's rows."""
    return new if ledger is None else ledger.select(*new.columns).unionByName(new)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger kept at a path; None if there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def keep_scan(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger at ``path`` lacks, appends it there, and returns the whole ledger."""
    spark = versions.sparkSession
    scan(versions, read_ledger(spark, path), rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def _hits(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, findings) of the blobs in which ``rules`` found something: structs (start, ord, kind, end) by
    start, then by the order of ``rules``."""
    asked = F.filter("findings", lambda x: F.array_contains(_names(rules), x["rule"]))
    hits = ledger.select("blob", asked.alias("findings")).where(F.size("findings") > 0)
    # several scans may have rows of one blob, and a repeated scan the same ones
    hits = hits.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("findings"))).alias("findings"))
    hits = hits.withColumn("findings", F.expr("filter(findings, (x, i) -> i = 0 OR x <> get(findings, i - 1))"))
    named = F.transform(
        "findings",
        lambda x: F.struct(x["start"].alias("start"), F.array_position(_names(rules), x["rule"]).alias("ord"), F.substring_index(x["rule"], "@", 1).alias("kind"), x["end"].alias("end")),
    )
    return hits.select("blob", F.sort_array(named).alias("findings"))


def with_findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``versions`` with the findings of ``rules`` that the ledger has for its blob. Most
    blobs have nothing, so the ledger's side is small; the paths of a blob that very many have are
    spread over tasks."""
    none = F.expr("cast(array() as array<struct<start:int,ord:bigint,kind:string,end:int>>)")
    return spread_join(versions, _hits(ledger, rules), "blob", "path").withColumn("findings", F.coalesce("findings", none))


def _span_list(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null text is empty text; texts without findings give zero counts, an empty list and the digest
    of the empty string. Findings with the same start go by the order of ``rules``. Repeated rows,
    and rows that repeat or lack an id, give a result each; an empty table gives none; other columns
    are ignored. With a ledger only what it lacks is scanned, and the report is the same.
    """
    versions = versions_of(docs)
    found = with_findings(versions.select("path", "blob"), merged(ledger, scan(versions, ledger, rules)), rules)
    base = F.filter("findings", lambda x: x["kind"].isin([r.kind for r in rules if r.base]))
    count = {r.kind: F.expr(f"CAST(size(filter(findings, x -> x.kind = '{r.kind}')) AS BIGINT)") for r in rules if r.base}
    return found.select(
        F.col("path").alias("doc_id"),
        *[n.alias(f"n_{k}") for k, n in count.items()],
        F.sha2(_span_list(base), 256).alias("base_sha256"),
        _span_list(F.col("findings")).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]", ledger: DataFrame | None = None) -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mark``; overlapping findings share one
    mark. Other columns and rows are untouched, whatever their names; null and empty texts stay as
    they are, repeated rows stay repeated, an empty table stays empty."""
    names = docs.columns
    blob, spans = unused(names, "_blob", "_spans")
    hits = _hits(merged(ledger, scan(versions_of(docs), ledger, rules)), rules).toDF(blob, spans)
    joined = spread_join(docs.withColumn(blob, F.sha2(text_of(), 256)), hits, blob, "doc_id")
    # a block of findings works on the text from the end of what was replaced before it up to its own last end
    each = f"struct(greatest(a.at, x.end) AS at, if(x.start >= a.at, concat(a.found, array(substring(part, a.at - o.at + 1, x.start - a.at), {_sql(mark)})), a.found) AS found)"
    after = "struct(r.at AS at, substring(o.rest, r.at - o.at + 1) AS rest, concat(o.found, array(array_join(r.found, ''))) AS found)"
    block = _let(f"aggregate(q, struct(o.at AS at, cast(array() as array<string>) AS found), (a, x) -> {each})", "r", after)
    block = _let("substring(o.rest, 1, greatest(array_max(transform(q, x -> x.end)) - o.at, 0))", "part", block)
    pieces = _in_blocks(spans, "struct(0 AS at, text AS rest, cast(array() as array<string>) AS found)", block)
    clean = _let(pieces, "z", "concat(array_join(z.found, ''), z.rest)")
    return joined.withColumn("text", F.expr(f"CASE WHEN {spans} IS NULL THEN text ELSE {clean} END")).select(*[f"`{c}`" for c in names])


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The report as SQL of DuckDB."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"""SELECT doc_id, {i} AS ord, '{r.kind}' AS kind, {str(r.base).lower()} AS base, {r.least} AS least, regexp_extract_all(t, {quoted(r.pattern)}, 0) AS m,
        regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS g, string_split_regex(t, {quoted(r.pattern)}) AS p FROM d"""
        for i, r in enumerate(rules)
    )
    count = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in rules if r.base)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}), x AS (
      SELECT doc_id, ord, kind, base, least, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(g) AS g, unnest(p[:len(m)]) AS p FROM f WHERE len(m) > 0
    ), y AS (SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY doc_id, ord ORDER BY i) AS stop FROM x),
    s AS (SELECT doc_id, ord, kind, base, stop - length(m) AS start, kind || ':' || CAST(stop - length(m) AS VARCHAR) || ':' || CAST(stop AS VARCHAR) AS span FROM y WHERE length(g) >= least),
    a AS (SELECT doc_id, {count}, string_agg(span, ',' ORDER BY start, ord) FILTER (base) AS b, string_agg(span, ',' ORDER BY start, ord) AS spans FROM s GROUP BY 1)
    SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in rules if r.base)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""
