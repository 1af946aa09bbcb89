"""Manifests → catalog tables: entities, columns, declared tests, lineage.

All keys carry ``project``, so the manifests of many projects are processed
together. Lookups (tests → owning node, dependencies → parents) are
equi-joins on metadata-sized tables; Catalyst broadcasts them by size.
Test lists and lineage keep their order through explicit positions, never
through ``collect_list`` order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import (DEFAULT_MODEL_SCHEMA, DEFAULT_SOURCE_SCHEMA, REF_TEMPLATE,
                               SOURCE_TEMPLATE)
from ..functions.strings import py_strip
from ..functions.testtext import inline_test_text, test_text_expr


@dataclass
class Catalog:
    entities: DataFrame   # project, kind, schema_name, table_name, slug, description, compiled_sql, node_id, pos
    columns: DataFrame    # project, node_id, pos, name, data_type, description, tests, meta
    tests: DataFrame      # project, node_id, column_name, test_text
    lineage: DataFrame    # project, node_id, pos, parent_id, parent_name, parent_description


# ─── filters and defaults ───────────────────────────────────────────────────

def prefix_filter(name: Column, include: list[str] | None, exclude: list[str] | None) -> Column:
    """Any exclude prefix drops the name (checked first); an empty include
    list keeps everything else; otherwise an include prefix is needed."""
    n = F.coalesce(name, F.lit(""))
    keep = F.lit(True)
    for p in exclude or []:
        keep = keep & ~F.startswith(n, F.lit(p))
    if include:
        any_inc = F.lit(False)
        for p in include:
            any_inc = any_inc | F.startswith(n, F.lit(p))
        keep = keep & any_inc
    return keep


def schema_or(schema: Column, default: str) -> Column:
    return F.coalesce(F.nullif(schema, F.lit("")), F.lit(default))


def slug(schema_name: Column, table_name: Column) -> Column:
    return F.concat_ws(".", schema_name, table_name)


# ─── tests ──────────────────────────────────────────────────────────────────

def _last_by(df: DataFrame, key: list, value: str) -> DataFrame:
    """Last-declared value per key (a later duplicate wins)."""
    return df.groupBy(*key).agg(F.max_by(value, "pos").alias(value))


def test_owners(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Each test node → ``(project, node_id, column_name, test_text)``.

    Owner, first that resolves: ``attached_node`` (empty counts as missing);
    else the ``model`` argument template — ``source('s','t')`` looked up among
    sources, or ``ref('m')`` among models (a failed ``source`` lookup does not
    try ``ref``); else the first dependency that is a model or source. Tests
    with no owner are dropped.
    """
    n = F.col("node")
    tests = nodes.where(n.getField("resource_type") == "test")
    kw = n.getField("test_metadata").getField("kwargs")
    model_arg = F.element_at(kw, F.lit("model"))
    template = F.when(F.schema_of_variant(model_arg) == "STRING", model_arg.cast("string"))
    src_hit = F.regexp_extract(F.coalesce(template, F.lit("")), SOURCE_TEMPLATE, 0) != ""
    src_key = F.concat(F.regexp_extract(template, SOURCE_TEMPLATE, 1), F.lit("."),
                       F.regexp_extract(template, SOURCE_TEMPLATE, 2))
    ref_name = F.nullif(F.regexp_extract(F.coalesce(template, F.lit("")), REF_TEMPLATE, 1), F.lit(""))
    deps = n.getField("depends_on").getField("nodes")
    first_dep = F.get(F.filter(F.coalesce(deps, F.array().cast("array<string>")),
                               lambda d: F.startswith(d, F.lit("model.")) | F.startswith(d, F.lit("source."))), 0)
    name = F.coalesce(F.nullif(n.getField("test_metadata").getField("name"), F.lit("")),
                      n.getField("name"), F.lit("unknown"))
    t = tests.select(
        "project", "pos",
        F.nullif(n.getField("attached_node"), F.lit("")).alias("attached"),
        src_hit.alias("src_hit"), F.when(src_hit, src_key).alias("src_key"),
        F.when(~src_hit, ref_name).alias("ref_name"), first_dep.alias("first_dep"),
        n.getField("column_name").alias("column_name"),
        test_text_expr(name, F.coalesce(kw, F.create_map().cast("map<string,variant>"))).alias("test_text"))

    s = sources.where(F.col("node.source_name").isNotNull() & F.col("node.name").isNotNull())
    src_by_name = _last_by(
        s.select("project", "pos", F.lit("source").alias("kind"), F.concat_ws(".", "node.source_name", "node.name").alias("name"),
                 F.col("node_id").alias("found_id")), ["project", "kind", "name"], "found_id")
    m = nodes.where((F.col("node.resource_type") == "model") & F.col("node.name").isNotNull())
    model_by_name = _last_by(
        m.select("project", "pos", F.lit("ref").alias("kind"), F.col("node.name").alias("name"), F.col("node_id").alias("found_id")),
        ["project", "kind", "name"], "found_id")
    # one lookup by source or model name; a test without one has a name of its own
    # that finds nothing, so that such tests are spread over all tasks
    kind = F.when(F.col("src_hit"), "source").when(F.col("ref_name").isNotNull(), "ref").otherwise("none")
    t = t.withColumns({"kind": kind, "name": F.coalesce("src_key", "ref_name", F.concat(F.lit("#"), F.col("pos").cast("string")))})
    j = t.join(src_by_name.unionByName(model_by_name), ["project", "kind", "name"], "left")
    owner = F.coalesce("attached", "found_id", "first_dep")
    return (j.select("project", owner.alias("node_id"), "column_name", "test_text")
            .where(F.col("node_id").isNotNull()))


def test_index(tests: DataFrame) -> DataFrame:
    """``(project, node_id, column_name) → sorted test texts``."""
    return (tests.groupBy("project", "node_id", "column_name")
            .agg(F.sort_array(F.collect_list("test_text")).alias("indexed")))


# ─── columns ────────────────────────────────────────────────────────────────

def _inline_tests(col: Column) -> Column:
    """``data_tests`` when non-empty, else ``tests``; each element parsed both
    as a variant (type) and as JSON text (key order)."""
    dt = F.from_json(col.getField("data_tests"), "array<variant>")
    use_dt = F.coalesce(F.size(dt), F.lit(0)) > 0
    src = F.when(use_dt, col.getField("data_tests")).otherwise(col.getField("tests"))
    items = F.coalesce(F.from_json(src, "array<variant>"), F.array().cast("array<variant>"))
    raws = F.from_json(src, "array<string>")
    return F.filter(F.transform(items, lambda x, i: inline_test_text(x, F.get(raws, i))),
                    lambda x: x.isNotNull())


def entity_columns(entity_nodes: DataFrame, index: DataFrame) -> DataFrame:
    """Columns in declared order; inline tests first (as declared), then the
    indexed tests on ``(node, column)``. Tests without a column are never
    attached to a column."""
    c = entity_nodes.select("project", "node_id",
                            F.posexplode(F.col("columns")).alias("pos", "name", "col"))
    c = c.select("project", "node_id", F.col("pos").cast("int").alias("pos"), "name",
                 F.col("col.data_type").alias("data_type"),
                 py_strip(F.coalesce(F.col("col.description"), F.lit(""))).alias("description"),
                 _inline_tests(F.col("col")).alias("inline"),
                 F.coalesce(F.col("col.meta"), F.lit("{}")).alias("meta"))
    idx = index.where(F.col("column_name").isNotNull()).withColumnRenamed("column_name", "name")
    return (c.join(idx, ["project", "node_id", "name"], "left")
            .select("project", "node_id", "pos", "name", "data_type", "description",
                    F.concat("inline", F.coalesce("indexed", F.array().cast("array<string>"))).alias("tests"),
                    "meta"))


# ─── lineage ────────────────────────────────────────────────────────────────

def lineage(model_nodes: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Parents of each model in dependency order. Model parents by name,
    source parents as ``source:<name>``; unknown ids and other kinds dropped."""
    deps = model_nodes.select("project", "node_id",
                              F.posexplode_outer(F.col("node.depends_on.nodes")).alias("pos", "parent_id"))
    deps = deps.where(F.col("parent_id").isNotNull())
    mp = nodes.where(F.startswith("node_id", F.lit("model."))).select(
        "project", F.col("node_id").alias("parent_id"), F.col("node.name").alias("parent_name"),
        F.coalesce(F.col("node.description"), F.lit("")).alias("parent_description"))
    sp = sources.where(F.startswith("node_id", F.lit("source."))).select(
        "project", F.col("node_id").alias("parent_id"),
        F.concat(F.lit("source:"), F.col("node.name")).alias("parent_name"),
        F.coalesce(F.col("node.description"), F.lit("")).alias("parent_description"))
    parents = mp.unionByName(sp).where(F.col("parent_name").isNotNull())
    return (deps.where(F.startswith("parent_id", F.lit("model.")) | F.startswith("parent_id", F.lit("source.")))
            .join(parents, ["project", "parent_id"], "inner")
            .select("project", "node_id", "pos", "parent_id", "parent_name", "parent_description"))


# ─── entities ───────────────────────────────────────────────────────────────

def compiled_choice(node: Column, found: Column, compiled_text: Column) -> Column:
    """Compiled file text when the file exists (blank → null); otherwise the
    trimmed ``raw_code`` (blank → null)."""
    comp = F.nullif(py_strip(F.coalesce(compiled_text, F.lit(""))), F.lit(""))
    raw = F.nullif(py_strip(F.coalesce(node.getField("raw_code"), F.lit(""))), F.lit(""))
    return F.when(found, comp).otherwise(raw)


def build_catalog(nodes: DataFrame, sources: DataFrame, include: list[str] | None = None,
                  exclude: list[str] | None = None, default_schema: str = DEFAULT_MODEL_SCHEMA,
                  compiled: DataFrame | None = None) -> Catalog:
    """Entities (models then sources, filtered by prefixes), their columns
    with tests, every resolved test, and model lineage."""
    n = F.col("node")
    models = nodes.where((n.getField("resource_type") == "model") &
                         prefix_filter(n.getField("name"), include, exclude))
    srcs = sources.where(prefix_filter(n.getField("name"), include, exclude))
    if compiled is not None:
        # files of one manifest go to it alone, others to every manifest of that name
        comp = compiled.select(F.col("project").alias("_project"), F.col("project_name").alias("_name"), F.col("path").alias("_path"),
                               F.col("text").alias("_ctext"), F.lit(True).alias("_found"))
        mj = models.join(comp, (F.col("project_name") == F.col("_name")) & (n.getField("path") == F.col("_path")) & (F.col("_path") != "")
                         & F.coalesce(F.col("_project") == F.col("project"), F.lit(True)), "left")
        found, ctext = F.coalesce(F.col("_found"), F.lit(False)), F.col("_ctext")
    else:
        mj, found, ctext = models, F.lit(False), F.lit(None).cast("string")
    m_ent = mj.select(
        "project", F.lit("model").alias("kind"),
        schema_or(n.getField("schema"), default_schema).alias("schema_name"),
        n.getField("name").alias("table_name"),
        F.coalesce(n.getField("description"), F.lit("")).alias("description"),
        compiled_choice(n, found, ctext).alias("compiled_sql"), "node_id", "pos")
    s_ent = srcs.select(
        "project", F.lit("source").alias("kind"),
        schema_or(n.getField("schema"), DEFAULT_SOURCE_SCHEMA).alias("schema_name"),
        n.getField("name").alias("table_name"),
        F.coalesce(n.getField("description"), F.lit("")).alias("description"),
        F.lit(None).cast("string").alias("compiled_sql"), "node_id", "pos")
    ents = m_ent.unionByName(s_ent).withColumn("slug", slug(F.col("schema_name"), F.col("table_name")))
    ents = ents.select("project", "kind", "schema_name", "table_name", "slug", "description",
                       "compiled_sql", "node_id", "pos")
    tests = test_owners(nodes, sources)
    cols = entity_columns(models.select("project", "node_id", F.col("node.columns").alias("columns"))
                          .unionByName(srcs.select("project", "node_id", F.col("node.columns").alias("columns"))),
                          test_index(tests))
    lin = lineage(models, nodes, sources)
    return Catalog(ents, cols, tests, lin)


def ordered(entities: DataFrame) -> DataFrame:
    """Entity order: kind, schema, table (models before sources)."""
    return entities.orderBy("project", "kind", "schema_name", "table_name", "pos")


def dedupe_by_slug(entities: DataFrame) -> DataFrame:
    """One entity per relation: when a model and a source share a slug, the
    later one in entity order (the source) wins."""
    key = F.struct("kind", "schema_name", "table_name", "pos")
    picked = entities.groupBy("project", "slug").agg(F.max_by(F.struct(*entities.columns), key).alias("e"))
    return picked.select("e.*")
