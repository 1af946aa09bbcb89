"""Head samples, rendered cells, transposed sample lines, and the
sample-cache validity and refresh plan.

A sample is a handful of rows per table (the limit is the feature). Cells
are masked (PII columns) or scrubbed, then cut, entirely in expressions.
Sample rows of many tables travel in one long format ``(project, slug, rn,
col_pos, column_name, value)`` so they can be unioned, cached and rendered
together. A table is known by ``(project, slug)``: projects may share slugs.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import (PII_REDACTED, SAMPLE_CACHE_VERSION, SAMPLE_LINE, SAMPLE_SEPARATOR,
                               SAMPLE_SIZE)
from ..functions.rules import DEFAULT_RULES, ScrubRule, scrub
from ..functions.strings import cell, template
from ..session import materialize
from .protect import pii_columns, pii_expr

log = logging.getLogger(__name__)

LONG_SCHEMA = "project string, slug string, rn int, col_pos int, column_name string, value string"
#: Project of tables that no manifest declares (``manifest.entities_from_tables``).
SESSION = "session"
KEY = ["project", "slug"]


# ─── head sample and cells ──────────────────────────────────────────────────

def head(df: DataFrame, n: int = SAMPLE_SIZE, order_by: list[str] | None = None) -> DataFrame | None:
    """First ``n`` rows (``n <= 0`` → no sample). With ``order_by`` the sample
    is repeatable (TakeOrderedAndProject: a top-n per task, one small merge)."""
    if n <= 0:
        return None
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)


def cell_text(c: Column, rules: tuple[ScrubRule, ...] = DEFAULT_RULES) -> Column:
    """Sample cell: null → ``NULL``; ``|`` escaped, newline → space; scrubbed
    on the whole value, then cut to 80 characters with an ellipsis."""
    return cell(c, lambda s: scrub(s, rules))


def render_cells(df: DataFrame, meta: dict | None = None, rules: tuple[ScrubRule, ...] = DEFAULT_RULES,
                 documented=None) -> DataFrame:
    """Every column as display text: PII columns ``<pii>``, others cells."""
    masked = pii_columns(df, meta, documented)
    return df.select(*[
        (F.lit(PII_REDACTED) if f.name in masked else cell_text(F.col(f"`{f.name}`"), rules)).alias(f.name)
        for f in df.schema.fields])


def to_long(df: DataFrame, slug: str, order_by: list[str] | None = None,
            masked: set[str] | None = None, project: str = SESSION) -> DataFrame:
    """Sample rows → ``(project, slug, rn, col_pos, column_name, value, is_pii)`` with
    raw values as text; :func:`render_long` turns them into display cells.

    The (at most a handful of) head rows are gathered into one array and
    numbered by position, so no exchange is needed after the top-n."""
    masked = masked or set()
    cols = df.columns
    keys = [F.col(f"`{k}`") for k in (order_by or [])]
    row = F.struct(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(order_by or [])],
                   F.struct(*[F.col(f"`{c}`").cast("string").alias(f"v{i}") for i, c in enumerate(cols)]).alias("_v"))
    rows = df.agg(F.sort_array(F.collect_list(row)).alias("_rows")) if keys else \
        df.agg(F.collect_list(row).alias("_rows"))
    per_row = rows.select(F.posexplode("_rows").alias("_rn", "_r"))
    entries = F.array(*[F.struct(F.lit(i).alias("col_pos"), F.lit(c).alias("column_name"),
                                 F.col("_r._v").getField(f"v{i}").alias("value"),
                                 F.lit(c in masked).alias("is_pii")) for i, c in enumerate(cols)])
    return per_row.select(F.lit(project).alias("project"), F.lit(slug).alias("slug"), (F.col("_rn") + 1).cast("int").alias("rn"),
                          F.inline(entries))


def render_long(long: DataFrame, rules: tuple[ScrubRule, ...] = DEFAULT_RULES) -> DataFrame:
    """Display cells for long sample rows: ``<pii>`` or the scrubbed, cut cell."""
    return long.select(*KEY, "rn", "col_pos", "column_name",
                       F.when(F.col("is_pii"), F.lit(PII_REDACTED))
                       .otherwise(cell_text(F.col("value"), rules)).alias("value"))


def sample_long(df: DataFrame, slug: str, n: int = SAMPLE_SIZE, order_by: list[str] | None = None,
                meta: dict | None = None, rules: tuple[ScrubRule, ...] = DEFAULT_RULES) -> DataFrame | None:
    h = head(df, n, order_by)
    if h is None:
        return None
    return render_long(to_long(h, slug, order_by, pii_columns(df, meta)), rules)


# Tables per sampling job: bounds the plan size when a warehouse has thousands.
SAMPLE_GROUP = 64


def _raw_heads(heads: list[tuple[tuple[str, str], DataFrame]]) -> list[DataFrame]:
    """The raw rows of a group as written tables. A group that fails is halved
    until the failing tables stand alone; those are left out with a warning."""
    raw = heads[0][1]
    for _, lg in heads[1:]:
        raw = raw.unionByName(lg)
    try:
        return [materialize(raw, "samples")]
    except Exception as e:  # any failure of a source ends that table's sample only
        if len(heads) == 1:
            log.warning("no sample of %s: %s", heads[0][0], str(e).split("\n", 1)[0])
            return []
        half = len(heads) // 2
        return _raw_heads(heads[:half]) + _raw_heads(heads[half:])


def samples_long(tables: dict, n: int = SAMPLE_SIZE, meta: dict | None = None,
                 rules: tuple[ScrubRule, ...] = DEFAULT_RULES, group: int = SAMPLE_GROUP) -> DataFrame | None:
    """Head samples of many tables ``{key: (df, order_by)}`` in one long
    table; masking and scrubbing are applied once, after the union. A key is
    ``(project, slug)``, or a slug of the session's own tables.

    Tables are sampled in groups (one job per group, written as a table in
    the shared folder, so no plan carries thousands of branches). Cutting
    the lineage of the raw rows (at most ``n`` per table) also stops the
    optimizer from pushing the scrub projection back into every branch and
    compiling it once per table. A table that can't be read has no sample;
    the others keep theirs."""
    heads = []
    for key, (df, order_by) in tables.items():
        project, slug = key if isinstance(key, tuple) else (SESSION, key)
        try:
            h = head(df, n, order_by)
            if h is not None:
                heads.append(((project, slug), to_long(h, slug, order_by, pii_columns(df, (meta or {}).get(key)), project)))
        except Exception as e:  # the table is not there any more, or never was readable
            log.warning("no sample of %s: %s", (project, slug), str(e).split("\n", 1)[0])
    parts = [p for i in range(0, len(heads), group) for p in _raw_heads(heads[i:i + group])]
    if not parts:
        return None
    raw = parts[0]
    for p in parts[1:]:
        raw = raw.unionByName(p)
    return render_long(raw, rules)


def transposed_lines(long: DataFrame) -> DataFrame:
    """One line per column: ``- `col`: v1 | v2 | …`` in row order, plus the
    row count: ``(project, slug, col_pos, column_name, n_rows, line)``."""
    g = long.groupBy(*KEY, "col_pos", "column_name").agg(
        F.sort_array(F.collect_list(F.struct("rn", "value"))).alias("vs"))
    return g.select(*KEY, "col_pos", "column_name", F.size("vs").alias("n_rows"),
                    template(SAMPLE_LINE, column=F.col("column_name"),
                             values=F.array_join(F.transform("vs", lambda x: x.getField("value")),
                                                 SAMPLE_SEPARATOR)).alias("line"))


# ─── cache fingerprints ─────────────────────────────────────────────────────

def json_string(s: Column) -> Column:
    """JSON string literal exactly as Python ``json.dumps`` writes it
    (ASCII only: other characters as ``\\uXXXX``, astral ones as surrogate pairs)."""
    def esc(ch):
        return (F.when(ch == '"', F.lit('\\"')).when(ch == "\\", F.lit("\\\\"))
                .when(ch == "\n", F.lit("\\n")).when(ch == "\r", F.lit("\\r"))
                .when(ch == "\t", F.lit("\\t")).when(ch == "\b", F.lit("\\b"))
                .when(ch == "\f", F.lit("\\f"))
                .when((ch < F.lit(" ")) | (ch > F.lit("~")),
                      F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))), "(.{4})", "\\\\u$1"))
                .otherwise(ch))
    chars = F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))
    return F.concat(F.lit('"'), F.array_join(F.transform(chars, esc), ""), F.lit('"'))


def names_hash(names: Column) -> Column:
    """``sha256:`` + hash of the JSON list of sorted distinct names (order and
    types ignored), written with ``", "`` separators as Python does."""
    items = F.transform(F.array_sort(F.array_distinct(names)), json_string)
    return F.concat(F.lit("sha256:"),
                    F.sha2(F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")), 256))


def entity_fingerprints(columns: DataFrame) -> DataFrame:
    """Per entity: column-name hash and the PII map as a sorted array of
    ``(name, pii)`` (map columns cannot be compared)."""
    c = columns.withColumn("is_pii", pii_expr(F.col("name"), F.col("meta")))
    return c.groupBy("project", "node_id").agg(
        names_hash(F.collect_list("name")).alias("column_names_hash"),
        F.sort_array(F.collect_list(F.struct("name", "is_pii"))).alias("pii_map"))


CACHE_SCHEMA = ("project string, slug string, version int, schema_name string, table_name string, fetched_at string, "
                "column_names_hash string, obfuscation_hash string, "
                "columns array<struct<name:string, data_type:string, pii:boolean>>, "
                "rows array<map<string,string>>, row_order array<string>")


def cache_validity(entities: DataFrame, fingerprints: DataFrame, cache: DataFrame,
                   obfuscation_hash: str) -> DataFrame:
    """Entities ⟕ cache on project and slug with ``cache_valid``: version, ruleset hash,
    column-name hash and PII map all agree and rows are present."""
    cached_pii = F.sort_array(F.transform(
        F.coalesce(F.col("c_columns"), F.array().cast("array<struct<name:string,data_type:string,pii:boolean>>")),
        lambda x: F.struct(x.getField("name").alias("name"),
                           F.coalesce(x.getField("pii"), F.lit(False)).alias("is_pii"))))
    c = cache.select(*KEY, F.col("version").alias("c_version"),
                     F.col("obfuscation_hash").alias("c_obf"), F.col("column_names_hash").alias("c_names"),
                     F.col("columns").alias("c_columns"), F.col("rows").alias("c_rows"))
    e = entities.join(fingerprints, ["project", "node_id"], "left")
    j = e.join(c, KEY, "left")
    valid = ((F.col("c_version") == SAMPLE_CACHE_VERSION) & (F.col("c_obf") == F.lit(obfuscation_hash))
             & (F.col("c_names") == F.coalesce(F.col("column_names_hash"), names_hash(F.array().cast("array<string>"))))
             & (cached_pii == F.coalesce(F.col("pii_map"), F.array().cast("array<struct<name:string,is_pii:boolean>>")))
             & F.col("c_rows").isNotNull())
    return j.withColumn("cache_valid", F.coalesce(valid, F.lit(False)))


def refresh_plan(validity: DataFrame, sample_size: int = SAMPLE_SIZE, refresh_all: bool = False,
                 refresh: list | None = None, can_fetch: bool = True) -> DataFrame:
    """Per entity the sample action before any fetch: ``none``, ``reuse``,
    ``reuse_warn`` (refresh asked but nothing can fetch) or ``fetch``.
    ``refresh`` names slugs (of any project) or ``(project, slug)`` pairs."""
    force = F.lit(refresh_all)
    for r in [] if refresh_all else refresh or []:
        force = force | ((F.col("project") == r[0]) & (F.col("slug") == r[1]) if isinstance(r, tuple) else F.col("slug") == r)
    valid = F.col("cache_valid")
    if sample_size <= 0:
        action = F.lit("none")
    elif not can_fetch:
        action = (F.when(~force & valid, F.lit("reuse")).when(force & valid, F.lit("reuse_warn"))
                  .otherwise(F.lit("none")))
    else:
        action = F.when(~force & valid, F.lit("reuse")).otherwise(F.lit("fetch"))
    return validity.withColumn("action", action)


def after_fetch(plan: DataFrame, fetched: DataFrame) -> DataFrame:
    """``fetched`` (project, slug): entities whose fetch gave rows. Outcome once fetches ran: rows → ``use_new``; no rows → reuse the valid
    cache with a warning, else none."""
    got = fetched.select(*KEY, F.lit(True).alias("_got")).distinct()
    j = plan.join(got, KEY, "left")
    return j.withColumn("action", F.when(F.col("action") != "fetch", F.col("action"))
                        .when(F.coalesce(F.col("_got"), F.lit(False)), F.lit("use_new"))
                        .when(F.col("cache_valid"), F.lit("reuse_warn"))
                        .otherwise(F.lit("none"))).drop("_got")


def cache_rows(rendered_long: DataFrame, entities: DataFrame, fingerprints: DataFrame, columns: DataFrame,
               obfuscation_hash: str) -> DataFrame:
    """Sample-cache records (``CACHE_SCHEMA``) for freshly rendered samples:
    the rendered cells (what the documents show, so the cache adds no new
    PII surface), plus what decides validity next time."""
    import datetime as _dt
    now = _dt.datetime.now(_dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    per_row = rendered_long.groupBy(*KEY, "rn").agg(
        F.sort_array(F.collect_list(F.struct("col_pos", "column_name", "value"))).alias("cells"))
    rows = per_row.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("rn", "cells"))).alias("rs"))
    rows = rows.select(*KEY, F.transform("rs", lambda r: F.map_from_entries(F.transform(
        r.getField("cells"), lambda c: F.struct(c.getField("column_name"), c.getField("value"))))).alias("rows"),
        F.transform(F.get(F.col("rs"), 0).getField("cells"), lambda c: c.getField("column_name")).alias("row_order"))
    c = columns.withColumn("is_pii", pii_expr(F.col("name"), F.col("meta")))
    cols = c.groupBy("project", "node_id").agg(F.sort_array(F.collect_list(F.struct(
        "pos", F.struct(F.col("name").alias("name"), F.col("data_type").alias("data_type"),
                        F.col("is_pii").alias("pii")).alias("c")))).alias("cs"))
    cols = cols.select("project", "node_id", F.transform("cs", lambda x: x.getField("c")).alias("columns"))
    e = entities.join(fingerprints, ["project", "node_id"], "left").join(cols, ["project", "node_id"], "left")
    return e.join(rows, KEY).select(
        *KEY, F.lit(SAMPLE_CACHE_VERSION).alias("version"), "schema_name", "table_name",
        F.lit(now).alias("fetched_at"), "column_names_hash", F.lit(obfuscation_hash).alias("obfuscation_hash"),
        F.coalesce("columns", F.array().cast("array<struct<name:string,data_type:string,pii:boolean>>")).alias("columns"),
        "rows", "row_order")


def long_from_cache(cache: DataFrame) -> DataFrame:
    """Cached rendered rows back to the long format, in the cached column order."""
    r = cache.select(*KEY, "row_order", F.posexplode("rows").alias("i", "row"))
    return r.select(*KEY, (F.col("i") + 1).cast("int").alias("rn"),
                    F.posexplode("row_order").alias("col_pos", "column_name"), "row") \
        .select(*KEY, "rn", F.col("col_pos").cast("int"), "column_name",
                F.element_at("row", F.col("column_name")).alias("value"))
