"""Find and protect personal data: names, flags, masking, scrubbing, scans.

Everything is a projection or a single global aggregate, so it runs with no
shuffle on any table size and on streams unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import PII_NAME_PATTERNS, PII_REDACTED, PII_SKIP_PREFIXES
from ..functions.rules import DEFAULT_RULES, ScrubRule, match_counts, scrub

# One predicate for driver-side names and for columns of names: a personal
# name that doesn't begin like a flag or a count.
PII_NAME = f"(?s)^(?!{PII_SKIP_PREFIXES.removeprefix('^')})(?=.*?(?:{PII_NAME_PATTERNS}))"


# ─── PII by column name / flag ──────────────────────────────────────────────

def pii_name_expr(name) -> Column:
    """Whether a column name of a table of names looks personal."""
    n = F.col(name) if isinstance(name, str) else name
    return F.coalesce(n.rlike(PII_NAME), F.lit(False))


def name_looks_like_pii(name: str | None) -> bool:
    """The same for one name known to the driver."""
    return bool(re.search(PII_NAME, name or ""))


def meta_pii_flag(meta_json) -> Column:
    """True only when the column meta JSON holds the boolean ``pii: true``
    (the string ``"true"`` does not count)."""
    m = F.col(meta_json) if isinstance(meta_json, str) else meta_json
    v = F.try_parse_json(m)
    is_bool = F.schema_of_variant(F.try_variant_get(v, "$.pii", "variant")) == "BOOLEAN"
    return F.coalesce(is_bool & F.try_variant_get(v, "$.pii", "boolean"), F.lit(False))


def pii_expr(name, meta_json) -> Column:
    """PII decision: the meta flag wins over the skip-prefix veto; else the name."""
    return meta_pii_flag(meta_json) | F.coalesce(pii_name_expr(name), F.lit(False))


def pii_columns(df: DataFrame, meta: dict | None = None,
                documented: Iterable[str] | None = None) -> set[str]:
    """Names to mask: flagged in ``meta`` (``{name: {"pii": True}}``) or in the
    field metadata, or PII by name. ``documented`` limits name matching to a
    set of documented columns (the narrower behaviour); flags always count."""
    meta = meta or {}
    doc = set(documented) if documented is not None else None
    out = set()
    for f in df.schema.fields:
        flagged = (meta.get(f.name) or {}).get("pii") is True or f.metadata.get("pii") is True
        by_name = name_looks_like_pii(f.name) and (doc is None or f.name in doc)
        if flagged or by_name:
            out.add(f.name)
    return out


# ─── masking and scrubbing ──────────────────────────────────────────────────

def protect(df: DataFrame, meta: dict | None = None, rules: tuple[ScrubRule, ...] = DEFAULT_RULES,
            documented: Iterable[str] | None = None, unicode: bool = True) -> DataFrame:
    """Mask PII columns (every row, nulls included, becomes ``<pii>``) and
    scrub PII shapes inside every other string column. One projection."""
    masked = pii_columns(df, meta, documented)
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in masked:
            cols.append(F.lit(PII_REDACTED).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            cols.append(scrub(c, rules, unicode).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def scrub_column(df: DataFrame, column: str, rules: tuple[ScrubRule, ...] = DEFAULT_RULES,
                 out: str | None = None, unicode: bool = True) -> DataFrame:
    return df.withColumn(out or column, scrub(F.col(f"`{column}`"), rules, unicode))


# ─── scan ───────────────────────────────────────────────────────────────────

def pii_scan(df: DataFrame, table_name: str, columns: list[str] | None = None,
             rules: tuple[ScrubRule, ...] = DEFAULT_RULES, unicode: bool = True) -> DataFrame:
    """Per column and rule: rows scanned, rows with a match, their share of
    the rows (null for an empty table), matches.

    Each rule is counted on the raw value, so text matched by two rules
    (an IP that also has a phone shape) counts for both. One pass: every
    count is projected once, then one global aggregate (partial per task,
    one tiny merge), then unpivoted.
    """
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    pairs = [(c, r) for c in columns for r in rules]
    counts = df.select(*[match_counts(F.col(f"`{c}`"), rules, unicode).alias(f"c{k}") for k, c in enumerate(columns)])
    aggs = [F.count(F.lit(1)).alias("rows_total")]
    for i in range(len(pairs)):
        n = F.col(f"c{i // len(rules)}.n{i % len(rules)}")
        aggs += [F.count_if(n > 0).alias(f"m{i}"), F.sum(n).cast("long").alias(f"s{i}")]
    agg = counts.agg(*aggs)
    entries = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(r.name).alias("rule"),
                 F.col(f"m{i}").alias("rows_matched"),
                 F.coalesce(F.col(f"s{i}"), F.lit(0)).alias("match_count"))
        for i, (c, r) in enumerate(pairs)])
    out = agg.select(F.lit(table_name).alias("table_name"), "rows_total", F.inline(entries))
    return out.withColumn("share", F.try_divide(F.col("rows_matched").cast("double"), F.col("rows_total").cast("double")))


# ─── tagging ────────────────────────────────────────────────────────────────

def tag_pii(columns: DataFrame, table_col: str = "table_name", name_col: str = "name",
            meta_col: str = "meta") -> DataFrame:
    """Report which columns would be tagged: PII by name and not yet flagged →
    ``tagged``; already flagged → ``already``. Idempotent on its own output."""
    flagged = meta_pii_flag(F.col(meta_col))
    return (columns.where(pii_name_expr(F.col(name_col)))
            .select(F.col(table_col).alias("table_name"), F.col(name_col).alias("column_name"),
                    F.when(flagged, F.lit("already")).otherwise(F.lit("tagged")).alias("status")))


def apply_tags(columns: DataFrame, name_col: str = "name", meta_col: str = "meta") -> DataFrame:
    """Set ``pii: true`` in the meta JSON of PII-named columns, keeping every
    other key; already flagged columns are unchanged."""
    m = F.from_json(F.coalesce(F.col(meta_col), F.lit("{}")), "map<string,variant>")
    kept = F.map_filter(F.coalesce(m, F.create_map().cast("map<string,variant>")),
                        lambda k, v: k != "pii")
    new = F.to_json(F.map_concat(kept, F.create_map(F.lit("pii"), F.parse_json(F.lit("true")))))
    todo = pii_name_expr(F.col(name_col)) & ~meta_pii_flag(F.col(meta_col))
    return columns.withColumn(meta_col, F.when(todo, new).otherwise(F.col(meta_col)))


def tag_schema(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Mark columns as PII in the DataFrame schema (field metadata), keeping
    other metadata; defaults to every PII-named column."""
    names = set(names) if names is not None else {f.name for f in df.schema.fields
                                                   if name_looks_like_pii(f.name)}
    for f in df.schema.fields:
        if f.name in names and f.metadata.get("pii") is not True:
            df = df.withMetadata(f.name, {**f.metadata, "pii": True})
    return df
