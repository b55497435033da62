"""A guard for read-only SQL: walks Spark's own parsed plan, nodes and expressions, against allow-lists, then bounds the result."""

from __future__ import annotations

import datetime
import decimal
import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# What a statement may be made of, by the names of Spark's parsed plan.
NODES = set("""Project Filter Aggregate Sort GlobalLimit LocalLimit Join Union Distinct SubqueryAlias UnresolvedRelation UnresolvedWith
UnresolvedHaving UnresolvedInlineTable LocalRelation UnresolvedSubqueryColumnAliases Intersect Except LateralJoin OneRowRelation WithWindowDefinition""".split())
#: LocalRelation is VALUES of literals, which the parser itself makes. No division, no bit operators, no RLIKE, no CASE, no EXISTS, no lambdas.
EXPRESSIONS = set("""UnresolvedAttribute UnresolvedStar UnresolvedAlias Alias Literal UnresolvedFunction Cast SortOrder UnresolvedOrdinal
EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual And Or Not In InSubquery ListQuery ScalarSubquery LateralSubquery
IsNull IsNotNull Like ILike Between Add Subtract Multiply Remainder UnaryMinus UnaryPositive Concat
WindowExpression UnresolvedWindowExpression WindowSpecDefinition SpecifiedWindowFrame UnspecifiedFrame CurrentRow UnboundedPreceding UnboundedFollowing
StringTrim StringTrimLeft StringTrimRight Substring StringLocate CurrentDate CurrentTimestamp Now LocalTimestamp""".split())
FUNCTIONS = set("""abs ceil ceiling floor round mod power sqrt greatest least coalesce nullif lower upper length char_length trim btrim ltrim rtrim concat
concat_ws replace regexp_replace substring right position split_part current_date current_timestamp now localtimestamp date_part date_trunc extract to_char
to_date to_timestamp array_agg count sum avg min max bool_and bool_or every string_agg listagg row_number rank dense_rank lag lead first_value last_value
nth_value between""".split())
TYPES = set("smallint int bigint decimal(10,0) double float boolean string date timestamp interval binary".split())
MAX_CHARS, MAX_NODES, MAX_DEPTH, MAX_ROWS, MAX_BYTES, MAX_CELL = 100_000, 4_096, 8, 1_000, 4_000_000, 1_000_000


class Rejected(ValueError):
    """A statement that the guard does not let through."""


@dataclass(frozen=True)
class Bounded:
    columns: list[str]
    rows: list[list]
    truncated: bool
    reason: str | None


def _name(obj) -> str:
    return obj.getClass().getSimpleName().rstrip("$")


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


class _Walk:
    """One pass over a parsed plan; what is not allowed raises."""

    def __init__(self, tables: set[str]):
        self.tables, self.seen = tables, 0

    def count(self) -> None:
        self.seen += 1
        if self.seen > MAX_NODES:
            raise Rejected("too many nodes")

    def plan(self, node, ctes: frozenset, root: bool = True, sets: int = 0) -> None:
        self.count()
        kind = _name(node)
        if kind not in NODES:
            raise Rejected(f"{kind} is not allowed")
        if kind == "UnresolvedWith":
            for relation in _seq(node.cteRelations()):
                self.plan(relation._2(), ctes, False)
                ctes = ctes | {relation._1().lower()}
        if kind == "UnresolvedRelation":
            parts = [p.lower() for p in _seq(node.multipartIdentifier())]
            if len(parts) != 1 or (parts[0] not in ctes and parts[0] not in self.tables):
                raise Rejected(f"unknown table {'.'.join(parts)}")
        if kind in ("GlobalLimit", "LocalLimit"):
            if not root:
                raise Rejected("LIMIT inside a query is not allowed")
            if _name(node.limitExpr()) != "Literal":
                raise Rejected("LIMIT takes a number")
        if kind in ("Union", "Intersect", "Except"):
            sets += 1
            if sets > MAX_DEPTH:
                raise Rejected("set operations too deep")
        for e in [] if kind == "LocalRelation" else _seq(node.expressions()):
            self.expression(e, ctes)
        for child in _seq(node.children()):
            self.plan(child, ctes, root and kind in ("GlobalLimit", "LocalLimit", "UnresolvedWith"), sets)

    def expression(self, e, ctes: frozenset) -> None:
        self.count()
        kind = _name(e)
        if kind not in EXPRESSIONS:
            raise Rejected(f"{kind} is not allowed")
        if kind == "UnresolvedFunction":
            parts = [p.lower() for p in _seq(e.nameParts())]
            if len(parts) != 1 or parts[0] not in FUNCTIONS:
                raise Rejected(f"function {'.'.join(parts)} is not allowed")
        if kind == "Cast" and e.dataType().simpleString() not in TYPES:
            raise Rejected(f"cast to {e.dataType().simpleString()} is not allowed")
        if kind in ("ScalarSubquery", "ListQuery", "LateralSubquery"):
            self.plan(e.plan(), ctes, False)
        for child in _seq(e.children()):
            self.expression(child, ctes)


def check(spark: SparkSession, sql: str, tables: set[str]) -> None:
    """Raises Rejected unless the statement is one query over ``tables`` made of what is allowed.

    Spark's parser alone decides what the text says, so quotes, escapes and
    comments cannot hide a call; every function, cast, operator, table and
    subquery of the plan is looked up.
    """
    if not sql.strip():
        raise Rejected("empty")
    if len(sql) > MAX_CHARS:
        raise Rejected("too long")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().removesuffix(";"))
    except Exception as e:
        raise Rejected(f"not one SQL query: {str(e)[:200]}") from e
    _Walk({t.lower() for t in tables}).plan(plan, frozenset())


def guarded(spark: SparkSession, sql: str, tables: set[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """The checked statement's rows, at most ``max_rows``: a larger LIMIT or none is cut to that."""
    check(spark, sql, tables)
    return spark.sql(sql.strip().removesuffix(";")).limit(max_rows)


def safe_cell(value):
    """A value as JSON has it: decimals without trailing zeros, dates in ISO form; NaN, infinity and cells too large are errors."""
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("not a finite number")
    if isinstance(value, decimal.Decimal):
        plain = format(value, "f")
        return plain.rstrip("0").rstrip(".") if "." in plain else plain
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [safe_cell(v) for v in value]
    if value is None or isinstance(value, (bool, int, float)):
        return value
    if len(text := str(value)) > MAX_CELL:
        raise ValueError("a cell is too large")
    return text


def bounded(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, seconds: int | None = None) -> Bounded:
    """Rows up to a number of rows and of JSON bytes; says which bound cut them. After ``seconds`` the query is cancelled."""
    import threading

    spark, rows, size = df.sparkSession, [], 0
    tag = f"tidemark-{id(df)}"
    spark.addTag(tag)
    timer = threading.Timer(seconds, lambda: spark.interruptTag(tag)) if seconds else None
    try:
        if timer:
            timer.start()
        for row in df.limit(max_rows + 1).toLocalIterator():
            if len(rows) == max_rows:
                return Bounded(df.columns, rows, True, "row_limit")
            cells = [safe_cell(v) for v in row]
            size += len(json.dumps(cells, ensure_ascii=False).encode())
            if size > max_bytes:
                return Bounded(df.columns, rows, True, "payload_bytes")
            rows.append(cells)
        return Bounded(df.columns, rows, False, None)
    finally:
        if timer:
            timer.cancel()
        spark.removeTag(tag)


def redacted(sql: str) -> str:
    """The statement with its literals taken out: strings, numbers and booleans; names stay."""
    out = re.sub(r"'(?:[^'\\]|''|\\.)*'", "'<redacted>'", sql)
    parts = re.split(r"('<redacted>'|\"[^\"]*\"|`[^`]*`)", out)
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"(?i)\b(true|false)\b", "FALSE", re.sub(r"(?<![\w.])\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])", "0", parts[i]))
    return "".join(parts)
