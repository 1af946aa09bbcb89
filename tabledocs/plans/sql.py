"""Guarded read-only SQL over registered views.

``run_sql`` = lexical guard (F10) → parsed-plan check → optional result cache
→ ``spark.sql``. Catalyst does all optimisation; nothing here plans queries.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guard import guard_reason
from ..functions.strings import null_text
from ..session import materialize, written_in_order


class ReadOnlyViolation(ValueError):
    """Raised when a query is refused."""


# Plan-node class names that never belong in a read-only query.
_REFUSED_NODE_WORDS = ("Insert", "Command", "Statement", "ScriptTransformation",
                       "CreateTable", "ReplaceTable", "AsSelect", "DeleteFrom",
                       "UpdateTable", "MergeInto", "Drop", "Alter", "Cache",
                       "SetVariable", "Call")
# Functions that reach outside SQL (they run JVM methods).
_REFUSED_FUNCTIONS = {"java_method", "reflect", "try_reflect"}
# Without a parsed plan (Spark Connect) these are refused wherever they stand.
_REFUSED_LEXICAL = re.compile(r"\b(java_method|reflect|try_reflect|transform|identifier)\b|`[^`]*[/:][^`]*`", re.IGNORECASE)
_CATALYST = "org.apache.spark.sql.catalyst."


def guard_text(spark: SparkSession, sql: str) -> str | None:
    """Evaluate the guard expression on one string. The one-row local relation
    is folded by the optimizer, so no job is launched."""
    df = spark.createDataFrame([(sql,)], "sql string")
    return df.select(guard_reason("sql").alias("r")).first()["r"]


def _items(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _parsed_nodes(tree, gateway):
    """Every node of a parsed plan: plans, the bodies of CTEs, expressions,
    and the plans of subqueries in expressions."""
    from py4j.java_gateway import is_instance_of
    todo = [tree]
    while todo:
        node = todo.pop()
        yield node
        todo += [*_items(node.children()), *_items(node.innerChildren())]
        if is_instance_of(gateway, node, _CATALYST + "plans.QueryPlan"):
            todo += _items(node.expressions())
        elif is_instance_of(gateway, node, _CATALYST + "expressions.PlanExpression"):
            todo.append(node.plan())


def _refusal(spark: SparkSession, plan) -> str | None:
    """Why a parsed plan is refused; None if it only reads known tables."""
    gateway = spark.sparkContext._gateway
    nodes = [(n.getClass().getSimpleName(), n) for n in _parsed_nodes(plan, gateway)]
    named = {x._1().lower() for kind, n in nodes if kind == "UnresolvedWith" for x in _items(n.cteRelations())}
    for kind, node in nodes:
        if any(w in kind for w in _REFUSED_NODE_WORDS):
            return f"plan contains a refused operation: {kind}"
        if "WithUnresolvedIdentifier" in kind:
            return "names computed by IDENTIFIER are not allowed"
        if kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            parts = node.nameParts() if kind == "UnresolvedFunction" else node.name()
            if [*_items(parts)][-1].lower() in _REFUSED_FUNCTIONS:
                return "functions that call JVM methods are not allowed"
        if kind == "UnresolvedRelation":
            parts = [*_items(node.multipartIdentifier())]
            if len(parts) == 1 and parts[0].lower() in named:
                continue
            # a path read as a table (parquet.`/path`) is no table of the catalog
            if any("/" in x or ":" in x for x in parts) or not spark.catalog.tableExists(".".join("`" + x.replace("`", "``") + "`" for x in parts)):
                return "only registered tables and views can be read: " + ".".join(parts)
    return None


def check_plan(spark: SparkSession, sql: str) -> None:
    """Parse (never run) the text and inspect every node of the parsed plan.

    The parser refuses a second statement; every node is checked, the bodies
    of CTEs and subqueries included. Whatever can't be inspected is refused.
    """
    jss = getattr(spark, "_jsparkSession", None)
    if jss is None:  # Spark Connect: guard, lexical refusals, single-statement parse
        if _REFUSED_LEXICAL.search(sql):
            raise ReadOnlyViolation("scripts, JVM functions, computed names and file paths are not allowed")
        return
    try:
        reason = _refusal(spark, jss.sessionState().sqlParser().parsePlan(sql))
    except Exception as e:  # ParseException (e.g. two statements), or a node that can't be walked
        raise ReadOnlyViolation(f"could not check query: {(str(e).splitlines() or [repr(e)])[0]}") from None
    if reason:
        raise ReadOnlyViolation(reason)


def assert_read_only(spark: SparkSession, sql: str) -> None:
    reason = guard_text(spark, sql)
    if reason is not None:
        raise ReadOnlyViolation(reason)
    check_plan(spark, sql)


def run_sql(spark: SparkSession, sql: str, use_cache: bool = False,
            cache=None) -> tuple[DataFrame, bool]:
    """Guarded query → (DataFrame, cache_hit)."""
    assert_read_only(spark, sql)
    if use_cache and cache is not None:
        hit = cache.get(sql)
        if hit is not None:
            return hit, True
    df = spark.sql(sql)
    if use_cache and cache is not None:
        return cache.put(sql, df), False
    return df, False


# ─── structured result ──────────────────────────────────────────────────────

_PLAIN_TYPES = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType,
                T.LongType, T.FloatType, T.DoubleType)


def json_safe_columns(df: DataFrame) -> list:
    """Columns as JSON-safe values: strings, integers, floats and booleans kept,
    everything else (dates, timestamps, decimals, binary, nested) as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        out.append(c.alias(f.name) if isinstance(f.dataType, _PLAIN_TYPES)
                   else c.cast("string").alias(f.name))
    return out


def json_row(df: DataFrame):
    """Column: the row as one JSON object with JSON-safe values (nulls kept)."""
    return F.to_json(F.struct(*json_safe_columns(df)), {"ignoreNullFields": "false"})


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(json_row(df).alias("row_json"))


@dataclass
class QueryResult:
    """A query's whole result: ``frame`` (JSON-safe values) and its exact
    ``row_count``. Rows leave through a writer of ``frame``, one by one from
    ``iter_rows()``, or all at once from ``rows``, each at the caller's wish."""

    sql: str
    columns: list[dict[str, Any]]
    frame: DataFrame
    row_count: int
    cache_hit: bool
    elapsed_ms: int
    extra: dict = field(default_factory=dict)

    def iter_rows(self):
        for r in self.frame.toLocalIterator():
            yield r.asDict()

    @property
    def rows(self) -> list[dict[str, Any]]:
        return [r.asDict() for r in self.frame.collect()]


def execute(spark: SparkSession, sql: str, cache=None, log=None) -> QueryResult:
    """Structured result of a guarded query, whole and uncut."""
    started = time.perf_counter()
    try:
        df, hit = run_sql(spark, sql, use_cache=cache is not None, cache=cache)
    except ReadOnlyViolation as e:
        if log is not None:
            log.event("tool_call_rejected", tool="execute_sql", sql=sql, reason=str(e))
        raise
    # run once: what is counted is what is read
    safe = (df if hit or cache is not None else written_in_order(df, "result")).select(*json_safe_columns(df))
    n = safe.count()
    res = QueryResult(
        sql=sql, columns=[{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields],
        frame=safe, row_count=n, cache_hit=hit, elapsed_ms=int((time.perf_counter() - started) * 1000))
    if log is not None:
        log.event("tool_call_ok", tool="execute_sql", sql=sql, row_count=n, cache_hit=hit, elapsed_ms=res.elapsed_ms)
    return res


# ─── markdown table ─────────────────────────────────────────────────────────

def markdown_table_lines(df: DataFrame) -> DataFrame:
    """Left-justified markdown table as a DataFrame of ``(pos, line)``.

    The query runs once: its cells are written as a table, numbered in the
    query's order. An aggregate gives the column widths, another each written
    part's first position, which its rows meet by a join; each row is then
    padded in place. The plan is the same for any number of parts. ``pos`` 0
    and 1 are the header and rule; rows follow without gaps. Order by ``pos``.
    """
    cols = df.columns
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([(0, "No results")], "pos long, line string")
    cells = [null_text(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)]
    txt = materialize(df.select(*cells, F.monotonically_increasing_id().alias("id")), "markdown")
    part = F.shiftright("id", 33)
    widths = txt.agg(F.count("*").alias("n"), *[F.max(F.length(f"c{i}")).alias(f"w{i}") for i in range(len(cols))]).first()
    w = [max(len(c), widths[f"w{i}"] or 0) for i, c in enumerate(cols)]
    head = "| " + " | ".join(c.ljust(w[i]) for i, c in enumerate(cols)) + " |"
    rule = "| " + " | ".join("-" * x for x in w) + " |"
    top = spark.createDataFrame([(0, head), (1, rule)], "pos long, line string")
    # a row for each written part, of which the query had as many tasks
    sizes = txt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") + 2).alias("start"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.rpad(f"c{i}", w[i], " ") for i in range(len(cols))]), F.lit(" |"))
    rows = txt.select(part.alias("part"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), line.alias("line")).join(F.broadcast(starts), "part")
    return top.unionByName(rows.select((F.col("start") + F.col("at")).alias("pos"), "line"))


def monthly_revenue(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """Documented flagship roll-up: revenue per month, oldest first."""
    return (orders
            .groupBy(F.date_trunc("month", "o_orderdate").alias("month"))
            .agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
            .orderBy("month"))


MONTHLY_REVENUE_SQL = (
    "SELECT date_trunc('month', o_orderdate) AS month, "
    "round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1 ORDER BY 1"
)

__all__ = ["ReadOnlyViolation", "assert_read_only", "check_plan", "run_sql", "execute",
           "json_rows", "markdown_table_lines", "monthly_revenue", "cut"]
