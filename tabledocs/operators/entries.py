"""Catalog sections (``## Title`` → ``### `name``` → fields) as line tables,
kind hooks, and the event-catalog job over an events table.

Each entry's lines are one array built by a projection (no Python); a
section is the entries of one catalog ordered by name. Hooks are ordinary
Python functions registered per kind: ``intro(entries) -> (project, table_slug, pos,
line)`` and ``extras(entries) -> (project, table_slug, name, pos, line)``; a hook
that leaves ``project`` out gives its lines to the tables of that name in all
projects. An empty project stands for every project.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import (CATALOG_ENTRY, CATALOG_TITLE, EM_DASH, EVENTS_ATTRIBUTE, EVENTS_INTRO,
                               EVENTS_QUERY,
                               EVENTS_QUERY_COLUMN_SEPARATOR, EVENTS_QUERY_LABEL, FIELD_HEADING,
                               FIELD_INLINE, FIELD_ITEM, FIELD_KEY, FIELD_KEY_VALUE, FIELD_NO, FIELD_YES,
                               PLANS_DEPRECATED, PLANS_INTRO, PLANS_LINK, PLANS_TABLE_HEADER,
                               PLANS_TABLE_ROW, PLANS_TABLE_RULE)
from ..functions.strings import py_strip, py_title, template

ENTRY_MAP = "map<string,variant>"


# ─── spec fields ────────────────────────────────────────────────────────────

def label(key: Column) -> Column:
    """``seats_included`` → ``Seats included``."""
    k = F.replace(key, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(k, 1, 1)), F.lower(F.substring(k, 2, 1 << 30)))


def _vtype(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def py_str(v: Column) -> Column:
    """Python ``str()`` of a scalar variant: booleans ``True``/``False``, null ``None``."""
    t = _vtype(v)
    return (F.when(v.isNull() | (t == "VOID"), F.lit("None"))
            .when(t == "BOOLEAN", F.when(v.cast("boolean"), F.lit("True")).otherwise(F.lit("False")))
            .when(t.startswith("OBJECT") | t.startswith("ARRAY"), F.to_json(v))
            .otherwise(v.cast("string")))


def field_lines(key: Column, v: Column) -> Column:
    """Lines of one non-description field, by value type (empty → none)."""
    t = _vtype(v)
    lab = label(key)
    head = F.array(F.lit(""), template(FIELD_HEADING, label=lab))
    inline = lambda s: F.array(F.lit(""), template(FIELD_INLINE, label=lab, value=s))
    obj = F.from_json(F.to_json(v), ENTRY_MAP)
    by_key = lambda a, b: (F.when(a.getField("key") < b.getField("key"), F.lit(-1))
                           .when(a.getField("key") > b.getField("key"), F.lit(1)).otherwise(F.lit(0)))
    obj_lines = F.transform(
        F.array_sort(F.map_entries(obj), by_key),
        lambda e: F.when(
            (F.when(_vtype(e.getField("value")) == "STRING", py_strip(e.getField("value").cast("string")))
             .when(_vtype(e.getField("value")) == "VOID", F.lit(""))
             .otherwise(py_str(e.getField("value")))) == "",
            template(FIELD_KEY, key=e.getField("key")))
        .otherwise(template(FIELD_KEY_VALUE, key=e.getField("key"),
                            value=F.when(_vtype(e.getField("value")) == "STRING",
                                         py_strip(e.getField("value").cast("string")))
                            .otherwise(py_str(e.getField("value"))))))
    arr = F.try_variant_get(v, "$", "array<variant>")
    s = py_strip(v.cast("string"))
    empty = F.array().cast("array<string>")
    return (F.when(t.startswith("OBJECT"),
                   F.when(F.size(obj) > 0, F.concat(head, obj_lines)).otherwise(empty))
            .when(t.startswith("ARRAY"),
                  F.when(F.size(arr) > 0,
                         F.concat(head, F.transform(arr, lambda x: template(FIELD_ITEM, item=py_str(x)))))
                  .otherwise(empty))
            .when(t == "BOOLEAN", inline(F.when(v.cast("boolean"), F.lit(FIELD_YES)).otherwise(F.lit(FIELD_NO))))
            .when(t.isin("STRING"), F.when(s != "", inline(s)).otherwise(empty))
            .when(t == "VOID", empty)
            .otherwise(inline(v.cast("string"))))


def entry_lines(entries: DataFrame) -> DataFrame:
    """Adds ``lines``: heading, description, then fields in declared order."""
    spec = F.col("spec")
    desc = py_strip(F.coalesce(F.element_at(spec, F.lit("description")).cast("string"), F.lit("")))
    fields = F.flatten(F.transform(
        F.filter(F.map_entries(spec), lambda e: e.getField("key") != "description"),
        lambda e: field_lines(e.getField("key"), e.getField("value"))))
    lines = F.concat(F.array(template(CATALOG_ENTRY, name=F.col("name"))),
                     F.when(desc != "", F.array(F.lit(""), desc)).otherwise(F.array().cast("array<string>")),
                     F.coalesce(fields, F.array().cast("array<string>")))
    return entries.withColumn("lines", lines)


# ─── kinds and hooks ────────────────────────────────────────────────────────

IntroFn = Callable[[DataFrame], DataFrame]     # entries → (table_slug, pos, line)
ExtrasFn = Callable[[DataFrame], DataFrame]    # entries → (table_slug, name, pos, line)


@dataclass
class Kind:
    intro: IntroFn | None = None
    extras: ExtrasFn | None = None
    options: dict = field(default_factory=dict)


KINDS: dict[str, Kind] = {}


def register_kind(name: str, intro: IntroFn | None = None, extras: ExtrasFn | None = None,
                  **options) -> None:
    """Register hooks for a catalog kind; a later registration wins."""
    KINDS[name] = Kind(intro, extras, options)


_TABLE = ["project", "table_slug"]


def _of_projects(entries: DataFrame) -> DataFrame:
    """``entries`` with a project that is never null."""
    given = F.coalesce("project", F.lit("")) if "project" in entries.columns else F.lit("")
    return entries.withColumn("project", given)


def last_catalog_per_table(entries: DataFrame) -> DataFrame:
    """Only the last declared catalog per project and table counts, be it empty
    (``n_entries``); empty table names never match."""
    from pyspark.sql import Window
    cats = (_of_projects(entries).where(F.col("table_slug") != "").groupBy(*_TABLE, "kind", "title", "decl_pos")
            .agg(F.count("name").alias("n_entries")))
    w = Window.partitionBy(*_TABLE).orderBy(F.desc("decl_pos"))
    return cats.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def section_lines(entries: DataFrame, kinds: dict[str, Kind] | None = None) -> DataFrame:
    """Catalog section lines per table: ``(project, table_slug, kind, decl_pos, k1,
    k2, k3, line)`` sorted by the three keys. ``entries`` needs ``decl_pos``
    (declaration order); only the last catalog per table is rendered. An empty
    one gives a single null line, as its kind still labels the document."""
    from pyspark.sql import Window
    kinds = KINDS if kinds is None else kinds
    chosen = last_catalog_per_table(entries)
    e = _of_projects(entries).join(chosen.select(*_TABLE, "decl_pos"), [*_TABLE, "decl_pos"], "left_semi")
    e = entry_lines(e.where(F.col("name").isNotNull()))
    title = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.col("title")).otherwise(
        py_title(F.replace(F.col("kind"), F.lit("_"), F.lit(" "))))
    out = chosen.select(*_TABLE, F.lit(0).alias("k1"), F.lit(0).alias("k2"),
                        F.posexplode(F.when(F.col("n_entries") > 0, F.array(template(CATALOG_TITLE, title=title), F.lit("")))
                                     .otherwise(F.array(F.lit(None).cast("string")))).alias("k3", "line"))
    body = e.select(*_TABLE, "name", F.posexplode("lines").alias("k3", "line"))
    for kname, k in kinds.items():
        ek = e.where(F.col("kind") == kname)

        def placed(lines: DataFrame, ek=ek) -> DataFrame:
            return lines if "project" in lines.columns else lines.join(ek.select(*_TABLE).distinct(), "table_slug")
        if k.intro is not None:
            intro = placed(k.intro(ek))
            # intro lines then one blank line, only when the intro is non-empty
            end = intro.groupBy(*_TABLE).agg((F.max("pos") + 1).alias("pos")).withColumn("line", F.lit(""))
            out = out.unionByName(intro.select(*_TABLE, "pos", "line").unionByName(end.select(*_TABLE, "pos", "line"))
                                  .select(*_TABLE, F.lit(1).alias("k1"), F.lit(0).alias("k2"), F.col("pos").alias("k3"), "line"))
        if k.extras is not None:
            body = body.unionByName(placed(k.extras(ek)).select(*_TABLE, "name", (F.col("pos") + 1_000_000).alias("k3"), "line"))
    # entries sorted by name: rank inside each table
    ranks = e.select(*_TABLE, "name").distinct()
    ranks = ranks.withColumn("k2", F.row_number().over(Window.partitionBy(*_TABLE).orderBy("name")))
    out = out.unionByName(body.join(ranks, [*_TABLE, "name"]).select(*_TABLE, F.lit(2).alias("k1"), "k2", "k3", "line"))
    return out.join(chosen.select(*_TABLE, "kind", "decl_pos"), _TABLE)


def section_text(lines: DataFrame) -> DataFrame:
    """Join a table's section lines in order: ``(project, table_slug, kind,
    decl_pos, section)``; the section of an empty catalog is null."""
    g = lines.groupBy(*_TABLE, "kind", "decl_pos").agg(
        F.sort_array(F.collect_list(F.struct("k1", "k2", "k3", "line"))).alias("ls"))
    lines_of = F.transform("ls", lambda x: x.getField("line"))
    return g.select(*_TABLE, "kind", "decl_pos", F.when(F.exists(lines_of, F.isnotnull), F.array_join(lines_of, "\n")).alias("section"))


# ─── worked example kinds: events and plans ────────────────────────────────

def events_kind(column: str = "event", data_column: str = "data",
                core_columns: tuple[str, ...] = ("id", "created", "event"), head_limit: int = 5) -> Kind:
    """Events catalog: an intro on attribute access and one example query per
    event (core columns, then its attributes in name order). A declaration's
    own options of these names come before the arguments."""
    def option(entries: DataFrame, name: str, default) -> Column:
        given = F.get_json_object("options", f"$.{name}") if "options" in entries.columns else F.lit(None).cast("string")
        return F.coalesce(F.nullif(given, F.lit("")), F.lit(str(default)))

    def intro(entries: DataFrame) -> DataFrame:
        text = template(EVENTS_INTRO, column=option(entries, "column", column), data_column=option(entries, "data_column", data_column))
        return entries.select(*_TABLE, text.alias("line")).distinct().select(*_TABLE, F.lit(0).alias("pos"), "line")

    def extras(entries: DataFrame) -> DataFrame:
        attrs = F.element_at(F.col("spec"), F.lit("attributes"))
        keys = F.array_sort(F.coalesce(
            F.map_keys(F.from_json(F.to_json(attrs), ENTRY_MAP)), F.array().cast("array<string>")))
        data = option(entries, "data_column", data_column)
        attr_cols = F.transform(keys, lambda a: template(EVENTS_ATTRIBUTE, data_column=data, attr=a))
        core = F.from_json(option(entries, "core_columns", ""), "array<string>")
        core = F.when(F.size(core) > 0, core).otherwise(F.array(*[F.lit(c) for c in core_columns]).cast("array<string>"))
        cols = F.concat(core, attr_cols)
        sql = template(EVENTS_QUERY, columns=F.array_join(cols, EVENTS_QUERY_COLUMN_SEPARATOR), table=F.col("table_slug"),
                       column=option(entries, "column", column), name=F.col("name"), head_limit=option(entries, "head_limit", head_limit))
        block = F.when((F.col("table_slug") == "") | (F.size(cols) == 0), F.array(F.lit(""))).otherwise(
            F.array(F.lit(""), F.lit(EVENTS_QUERY_LABEL), F.lit(""), F.lit("```sql"), sql,
                    F.lit("```"), F.lit("")))
        return entries.select(*_TABLE, "name", F.posexplode(block).alias("pos", "line"))

    return Kind(intro, extras, {"column": column, "data_column": data_column,
                                "core_columns": list(core_columns), "head_limit": head_limit})


def _spec_text(key: str, default: str = EM_DASH) -> Column:
    v = F.element_at(F.col("spec"), F.lit(key))
    return F.when(v.isNull(), F.lit(default)).otherwise(py_str(v))


def plans_kind() -> Kind:
    """Plans catalog: a price/seats comparison table across entries, a
    deprecation callout and a pricing link per entry."""
    def intro(entries: DataFrame) -> DataFrame:
        rows = entries.select(*_TABLE, "name", template(
            PLANS_TABLE_ROW, name=F.col("name"), price=_spec_text("price"),
            seats=_spec_text("seats_included")).alias("row"))
        g = rows.groupBy(*_TABLE).agg(F.sort_array(F.collect_list(F.struct("name", "row"))).alias("rs"))
        lines = F.concat(F.array(F.lit(PLANS_INTRO), F.lit(""), F.lit(PLANS_TABLE_HEADER),
                                 F.lit(PLANS_TABLE_RULE)),
                         F.transform("rs", lambda r: r.getField("row")))
        return g.select(*_TABLE, F.posexplode(lines).alias("pos", "line"))

    def extras(entries: DataFrame) -> DataFrame:
        dep = F.element_at(F.col("spec"), F.lit("deprecated"))
        url = F.element_at(F.col("spec"), F.lit("pricing_page"))
        truthy = lambda v: (v.isNotNull() & (F.coalesce(v.cast("string"), F.lit("")) != "")
                            & (F.coalesce(v.cast("string"), F.lit("")) != "false")
                            & (F.coalesce(v.cast("string"), F.lit("")) != "0"))
        none = F.array().cast("array<string>")
        a = F.when(truthy(dep), F.array(F.lit(""), F.lit(PLANS_DEPRECATED))).otherwise(none)
        b = F.when(truthy(url), F.array(F.lit(""), template(PLANS_LINK, name=F.col("name"),
                                                           url=url.cast("string")))).otherwise(none)
        out = F.concat(a, b)
        out = F.when(F.size(out) > 0, F.concat(out, F.array(F.lit("")))).otherwise(out)
        return entries.select(*_TABLE, "name", F.posexplode(out).alias("pos", "line"))

    return Kind(intro, extras)


# ─── event catalog over an events table ────────────────────────────────────

def attribute_names(entries: DataFrame) -> DataFrame:
    """``(name, attribute, attr_pos)`` from each entry's ``attributes`` object."""
    attrs = F.from_json(F.to_json(F.element_at(F.col("spec"), F.lit("attributes"))), ENTRY_MAP)
    return entries.where(F.col("name").isNotNull()).select("name", F.posexplode_outer(F.array_sort(F.map_keys(attrs))).alias("attr_pos", "attribute"))


def json_attr(data: Column, attr: Column) -> Column:
    """``data."attr"::text``: JSON attribute as text, whatever its name holds."""
    return F.element_at(F.from_json(data, "map<string,string>"), attr)


def event_attributes(events: DataFrame, entries: DataFrame, name_col: str, data_col: str,
                     core_columns: list[str], head_limit: int | None = None,
                     max_catalog_rows: int = 100_000) -> DataFrame:
    """All documented events with their documented attributes, long form:
    core columns + ``attribute`` + ``value``. Undocumented events are dropped.

    The catalog (one row per documented event and attribute) is metadata: it
    is size-checked and broadcast, so the events table is never shuffled.
    Each event's JSON is parsed once, into a map of its attributes (values
    kept as JSON text, like ``->>``), before rows are multiplied by attribute. With ``head_limit`` only the first rows per
    event (by the core columns) are kept, as an example query shows.
    """
    attrs = attribute_names(entries).select(F.col("name").alias("_event"), "attribute", "attr_pos")
    # only how the catalog is joined depends on its size, never what is read
    small = attrs.limit(max_catalog_rows + 1).count() <= max_catalog_rows
    hint = F.broadcast if small else (lambda x: x)
    ev = events
    if head_limit is not None:
        from pyspark.sql import Window
        w = Window.partitionBy(name_col).orderBy(*core_columns)
        docs = attrs.select("_event").distinct()
        ev = (ev.join(hint(docs), ev[name_col] == docs["_event"], "left_semi")
              .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= head_limit).drop("_rn"))
    ev = ev.withColumn("_attrs", F.from_json(F.col(data_col), "map<string,string>"))
    value = F.element_at(F.col("_attrs"), F.col("attribute"))
    attrs = hint(attrs)
    j = ev.join(attrs, ev[name_col] == attrs["_event"], "inner")
    return j.select(*core_columns, "attribute", value.alias("value"))


def event_extract(events: DataFrame, name: str, name_col: str, data_col: str, core_columns: list[str],
                  attributes: list[str], head_limit: int | None = None) -> DataFrame:
    """One documented event: core columns plus each attribute (sorted by
    name) as text, like the catalog's example query. The filter reaches the
    scan; ``head_limit`` keeps the first rows by the core columns."""
    df = events.where(F.col(name_col) == F.lit(name)).select(
        *core_columns, *[json_attr(F.col(data_col), F.lit(a)).alias(a) for a in sorted(attributes)])
    if head_limit is not None:
        df = df.orderBy(*core_columns).limit(head_limit)
    return df
