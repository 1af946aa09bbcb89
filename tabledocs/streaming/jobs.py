"""Streaming variants of the stateless jobs.

Masking/scrubbing, SQL classification and audit-log parsing are per-row
expressions, so the same Column expressions run on ``readStream`` sources
unchanged: no state, no watermark, no window. Progress is kept in a
checkpoint under the shared folder, so a restarted query (or a lost
executor) resumes without loss or duplicates into the file sink.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.rules import DEFAULT_RULES, ScrubRule
from ..operators.audit import classify_queries, parse_lines
from ..operators.protect import protect
from ..session import shared_dir


def _sink(df: DataFrame, source: str, sink: str, checkpoint: str | None, name: str, available_now: bool,
          fmt: str = "parquet") -> StreamingQuery:
    """Without a checkpoint folder of the caller's, one for this kind of
    stream, source and sink in the shared folder."""
    spark = df.sparkSession
    own = hashlib.sha256(f"{source}\n{sink}".encode()).hexdigest()[:16]
    ckpt = checkpoint or shared_dir(spark, f"tabledocs/streams/{name}-{own}")
    w = df.writeStream.format(fmt).option("checkpointLocation", ckpt).outputMode("append")
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start(sink)


def protect_stream(spark: SparkSession, source: str, schema: str, sink: str, fmt: str = "parquet",
                   meta: dict | None = None, rules: tuple[ScrubRule, ...] = DEFAULT_RULES,
                   checkpoint: str | None = None, available_now: bool = True,
                   max_files_per_trigger: int | None = None) -> StreamingQuery:
    """New files under ``source`` are masked and scrubbed into ``sink``."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = r.load(source)
    return _sink(protect(stream, meta, rules), source, sink, checkpoint, "protect", available_now)


def guard_stream(spark: SparkSession, source: str, schema: str, sql_col: str, sink: str,
                 fmt: str = "parquet", checkpoint: str | None = None,
                 available_now: bool = True) -> StreamingQuery:
    """Classify incoming SQL texts (guard outcome + log hash)."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    return _sink(classify_queries(stream, sql_col), source, sink, checkpoint, "guard", available_now)


def audit_stream(spark: SparkSession, log_dir: str, sink: str, checkpoint: str | None = None,
                 available_now: bool = True) -> StreamingQuery:
    """Audit log lines (``key=value`` or JSON) from a folder of text files into a table."""
    stream = spark.readStream.text(log_dir)
    return _sink(parse_lines(stream, "value"), log_dir, sink, checkpoint, "audit", available_now)
