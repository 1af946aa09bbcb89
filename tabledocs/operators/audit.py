"""Query-log audit: event lines in and out, and a roll-up per query hash.

Event lines are ``key=value`` pairs (strings holding a space, ``=`` or ``"``
are quoted, with ``"`` escaped) or JSON objects. The roll-up groups by the
SQL hash; every aggregate is partial per task (map-side), and latency
percentiles use a bounded sketch unless exact values are asked for. For long
histories a day's events are reduced to one small row per hash (:func:`daily_state`)
whose sketches merge for any range of days (:func:`rollup_state`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guard import guard_reason, sql_log_hash
from ..functions.strings import let

AUDIT_SCHEMA = ("ts double, event string, tool string, sql_hash string, reason string, "
                "row_count bigint, cache_hit boolean, elapsed_ms bigint")
_FIELDS = ["ts", "event", "tool", "sql_hash", "reason", "row_count", "cache_hit", "elapsed_ms"]


def _kv_value(c: Column, dtype) -> Column:
    """Python ``str()`` of a value; strings needing quotes are quoted."""
    if isinstance(dtype, T.StringType):
        needs = F.contains(c, F.lit(" ")) | F.contains(c, F.lit("=")) | F.contains(c, F.lit('"'))
        return F.when(needs, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(c)
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).otherwise(F.lit("False"))
    if isinstance(dtype, T.DoubleType):
        return F.format_string("%.3f", c)
    return c.cast("string")


def event_lines(events: DataFrame, fmt: str = "kv") -> DataFrame:
    """Audit rows → one text line each (``line``). Null fields are left out;
    fields beyond the usual ones are written behind them."""
    cols = sorted(events.schema.fields, key=lambda f: _FIELDS.index(f.name) if f.name in _FIELDS else len(_FIELDS))
    maps = [f for f in cols if isinstance(f.dataType, T.MapType)]  # further fields, as ``parse_lines`` gives them
    cols = [f for f in cols if f not in maps]
    if fmt == "json":
        line = F.to_json(F.struct(*[F.col(f.name) for f in cols]))
        for f in maps:
            more = F.to_json(F.col(f.name))
            line = F.when(F.coalesce(F.size(f.name), F.lit(0)) <= 0, line).otherwise(
                F.concat(F.regexp_replace(line, r"\}$", ""), F.when(line != "{}", ",").otherwise(""), F.substring(more, F.lit(2), F.length(more))))
        return events.select(line.alias("line"))
    more = [F.array_join(F.transform(F.map_entries(f.name), lambda e: F.concat(e.getField("key"), F.lit("="), _kv_value(e.getField("value").cast("string"), T.StringType()))), " ")
            for f in maps]
    parts = [F.when(F.col(f.name).isNotNull(), F.concat(F.lit(f.name + "="), _kv_value(F.col(f.name), f.dataType)))
             for f in cols] + [F.when(m != "", m) for m in more]
    return events.select(F.concat_ws(" ", *parts).alias("line"))


_KV = r'([A-Za-z_][A-Za-z0-9_]*)=("(?:[^"\\]|\\.)*"|\S*)'


def _last_values(entries: Column) -> Column:
    """A map of ``array<struct<key, value>>``; the last value of a key counts."""
    def last(e: Column, i: Column) -> Column:
        later = F.slice(entries, i + 2, F.size(entries))
        return ~F.exists(later, lambda x: x.getField("key") == e.getField("key"))
    return F.map_from_entries(F.filter(entries, last))


def parse_lines(lines: DataFrame, col: str = "line") -> DataFrame:
    """Text lines (either format) → ``AUDIT_SCHEMA`` rows, and ``extra``, a
    map of all other fields. JSON lines are
    parsed by ``from_json``; ``key=value`` lines by one regex pass. Of a key
    that a line has twice, the last value counts."""
    line = F.col(col)
    is_json = F.startswith(F.ltrim(line), F.lit("{"))
    keys = F.regexp_extract_all(line, F.lit(_KV), F.lit(1))
    vals = F.transform(F.regexp_extract_all(line, F.lit(_KV), F.lit(2)),
                       lambda v: F.when(F.startswith(v, F.lit('"')),
                                        F.replace(F.regexp_replace(v, r'^"|"$', ""), F.lit('\\"'), F.lit('"')))
                       .otherwise(v))
    kv = F.zip_with(keys, vals, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    js = F.map_entries(F.from_json(line, "map<string,string>"))
    m = let(F.when(is_json, js).otherwise(kv), _last_values)
    get = lambda k: F.element_at(m, F.lit(k))
    return lines.select(
        get("ts").try_cast("double").alias("ts"), get("event").alias("event"), get("tool").alias("tool"),
        get("sql_hash").alias("sql_hash"), get("reason").alias("reason"),
        get("row_count").try_cast("bigint").alias("row_count"),
        F.when(F.lower(get("cache_hit")) == "true", True).when(F.lower(get("cache_hit")) == "false", False)
        .alias("cache_hit"),
        get("elapsed_ms").try_cast("bigint").alias("elapsed_ms"),
        F.map_filter(m, lambda k, v: ~k.isin(*_FIELDS)).alias("extra"))


def classify_queries(queries: DataFrame, sql_col: str = "sql") -> DataFrame:
    """Adds the guard outcome and the log hash to a table of SQL texts."""
    return queries.withColumn("reason", guard_reason(F.col(sql_col))) \
        .withColumn("sql_hash", sql_log_hash(F.col(sql_col)))


def rollup(audit: DataFrame, exact: bool = False) -> DataFrame:
    """Per SQL hash: calls, rejected calls, cache-hit share of accepted calls,
    rows returned, and p50 / p95 latency."""
    ok = F.col("event") == "tool_call_ok"
    lat = F.when(ok, F.col("elapsed_ms"))
    if exact:
        p50, p95 = F.percentile(lat, 0.5), F.percentile(lat, 0.95)
    else:
        p50, p95 = F.percentile_approx(lat, 0.5, 10000), F.percentile_approx(lat, 0.95, 10000)
    return audit.groupBy("sql_hash").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("event") == "tool_call_rejected").alias("rejected"),
        F.avg(F.when(ok, F.col("cache_hit").cast("double"))).alias("cache_hit_share"),
        F.sum(F.when(ok, F.col("row_count"))).alias("rows"),
        p50.alias("p50_ms"), p95.alias("p95_ms"))


#: Size parameter of the latency sketches: ranks within about half a percent.
SKETCH_K = 800


def daily_state(audit: DataFrame) -> DataFrame:
    """One row per SQL hash and UTC day: sums, and a sketch of the accepted
    calls' latencies, to be stored and merged. A row is bounded by ``SKETCH_K``,
    however many events it stands for."""
    ok = F.col("event") == "tool_call_ok"
    day = F.to_date(F.timestamp_seconds("ts")).alias("day")
    return audit.groupBy("sql_hash", day).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("event") == "tool_call_rejected").alias("rejected"),
        F.count_if(ok & F.col("cache_hit").isNotNull()).alias("judged"), F.count_if(ok & F.col("cache_hit")).alias("hits"),
        F.sum(F.when(ok, F.col("row_count"))).alias("rows"), F.kll_sketch_agg_bigint(F.when(ok, F.col("elapsed_ms")), F.lit(SKETCH_K)).alias("latency"))


def rollup_state(state: DataFrame, first=None, last=None) -> DataFrame:
    """:func:`rollup` over the days from ``first`` to ``last`` (both included,
    open where None), from :func:`daily_state` rows of any number of runs."""
    days = state
    if first is not None:
        days = days.where(F.col("day") >= F.lit(first))
    if last is not None:
        days = days.where(F.col("day") <= F.lit(last))
    out = days.groupBy("sql_hash").agg(
        *[F.sum(c).alias(c) for c in ("calls", "rejected", "judged", "hits", "rows")],
        F.kll_merge_agg_bigint("latency").alias("latency"))
    some = F.kll_sketch_get_n_bigint("latency") > 0
    at = lambda q: F.when(some, F.kll_sketch_get_quantile_bigint("latency", F.lit(q)))
    return out.select("sql_hash", "calls", "rejected", F.try_divide(F.col("hits").cast("double"), F.col("judged")).alias("cache_hit_share"), "rows",
                      at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"))


def classify_rollup(queries: DataFrame, sql_col: str = "sql") -> DataFrame:
    """A table of SQL texts rolled up per log hash: how many calls, how many
    the guard refuses. Partial counts per task before the shuffle, so a hash
    repeated a million times costs one row per task."""
    c = classify_queries(queries, sql_col)
    return c.groupBy("sql_hash").agg(F.count(F.lit(1)).alias("calls"),
                                     F.count_if(F.col("reason").isNotNull()).alias("rejected"))


class EventLog:
    """Events of guarded SQL calls (``execute(..., log=EventLog(spark))``).

    Events are kept on the driver only until ``flush``; one event per call,
    so the buffer is bounded by the calls made. ``flush`` turns them into an
    ``AUDIT_SCHEMA`` table with all other fields in ``extra`` (the SQL is hashed by the same expression as the
    log hash) and appends it to ``path`` when given (a shared folder)."""

    def __init__(self, spark, path: str | None = None):
        self.spark = spark
        self.path = path
        self._events: list[dict] = []

    def event(self, kind: str, **fields) -> None:
        import time
        self._events.append({"ts": time.time(), "event": kind, **fields})

    def flush(self) -> DataFrame:
        usual = ("ts", "event", "tool", "sql", "reason", "row_count", "cache_hit", "elapsed_ms")
        rows = [(*(e.get(k) for k in usual), {k: None if v is None else str(v) for k, v in e.items() if k not in usual}) for e in self._events]
        self._events = []
        df = self.spark.createDataFrame(
            rows, "ts double, event string, tool string, sql string, reason string, row_count bigint, "
                  "cache_hit boolean, elapsed_ms bigint, extra map<string,string>")
        out = df.select("ts", "event", "tool", sql_log_hash(F.col("sql")).alias("sql_hash"), "reason",
                        "row_count", "cache_hit", "elapsed_ms", "extra")
        if self.path:
            out.write.mode("append").parquet(self.path)
        return out
