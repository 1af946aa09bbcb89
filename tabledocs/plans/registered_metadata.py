"""Registered jobs of the operators that work on metadata: audit lines,
documents, notes, catalog entries, declared tests, lineage, refresh plans.

The given tables stand for the metadata, whole: parts are models, suppliers
are sources, order lines are declared tests, events are audit events,
documents are entities and bodies. The DuckDB SQL spells every literal itself.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import catalog as G
from ..operators import docs as D
from ..operators import entries as N
from ..operators import protect as P
from ..operators import samples as SM
from ..session import bytes_of, delete_at_end, delete_now, materialize, read_table, scans_spread, shared_dir, shuffles_dropped, shuffles_spread, spread, table_path
from ..sources.catalogs import catalog_entries
from ..sources.corpus import read_markdown_folder
from ..sources.manifest import read_compiled_sql, read_manifests
from ..sources.textfiles import write_files
from . import incremental as I

# ─── audit ──────────────────────────────────────────────────────────────────


def _audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an audit event of a guarded call, its id as a further field."""
    e = read_table(spark, sf_dir, "events")
    bad = F.col("event_type") == "error"
    return e.select(
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("double").alias("ts"),
        F.when(bad, "tool_call_rejected").otherwise("tool_call_ok").alias("event"), F.lit("run query").alias("tool"),
        F.concat(F.lit("u"), F.col("user_id")).alias("sql_hash"), F.when(bad, 'has "a=b" in it').alias("reason"),
        F.get_json_object("props", "$.k").cast("bigint").alias("row_count"), (F.col("event_type") == "view").alias("cache_hit"),
        F.round(F.col("value") * 100).cast("bigint").alias("elapsed_ms"), F.col("event_id").cast("string").alias("event_id"))


def audit_lines(spark, sf_dir):
    return A.event_lines(_audit_events(spark, sf_dir))


def audit_round_trip(spark, sf_dir):
    """Written as lines of both formats, each with a key that stands twice, and read back."""
    e = _audit_events(spark, sf_dir)
    twice = {"kv": F.concat(F.lit("tool=first event_id=0 "), "line"), "json": F.concat(F.lit('{"tool":"first","event_id":"0",'), F.substring("line", 2, 1 << 30))}
    read = [A.parse_lines(A.event_lines(e, f).select(twice[f].alias("line"))).withColumn("fmt", F.lit(f)) for f in ("kv", "json")]
    return read[0].unionByName(read[1]).withColumn("event_id", F.element_at("extra", F.lit("event_id"))).drop("extra")


def audit_rollup(spark, sf_dir):
    return A.rollup(_audit_events(spark, sf_dir), exact=True)


def audit_days(spark, sf_dir):
    """Daily states merged over all days, their percentiles against the exact ranks."""
    e = _audit_events(spark, sf_dir)
    merged = A.rollup_state(A.daily_state(e))
    lat = e.where("event = 'tool_call_ok' and elapsed_ms is not null").select("sql_hash", "elapsed_ms")
    share = lambda c: F.avg(c.cast("double"))
    within = lambda p, q: (share(F.col("elapsed_ms") < F.col(p)) <= q + 0.02) & (share(F.col("elapsed_ms") <= F.col(p)) >= q - 0.02)
    ranks = lat.join(merged.select("sql_hash", "p50_ms", "p95_ms"), "sql_hash").groupBy("sql_hash").agg(
        within("p50_ms", 0.5).alias("p50_within"), within("p95_ms", 0.95).alias("p95_within"))
    return merged.drop("p50_ms", "p95_ms").join(ranks, "sql_hash", "left")


_AUDIT = """(SELECT floor(epoch(ts))::DOUBLE AS ts, CASE WHEN event_type = 'error' THEN 'tool_call_rejected' ELSE 'tool_call_ok' END AS event,
 'run query' AS tool, 'u' || user_id AS sql_hash, CASE WHEN event_type = 'error' THEN 'has "a=b" in it' END AS reason,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS row_count, event_type = 'view' AS cache_hit,
 CAST(round(value * 100) AS BIGINT) AS elapsed_ms, CAST(event_id AS VARCHAR) AS event_id FROM events)"""


def event_extract(spark, sf_dir):
    return N.event_extract(read_table(spark, sf_dir, "events"), "purchase", "event_type", "props", ["event_id", "ts"], ["missing", "k"])


# ─── documents ──────────────────────────────────────────────────────────────

NOTES = "<!-- ↓ MANUAL NOTES BELOW (PRESERVED ACROSS REGENERATION) ↓ -->"


def docs_index(spark, sf_dir):
    """The index of all documents: languages are projects, long texts models."""
    d = read_table(spark, sf_dir, "documents")
    ents = d.select(F.coalesce("lang", F.lit("none")).alias("project"), F.when(F.col("n_chars") > 1000, "model").otherwise("source").alias("kind"),
                    F.coalesce("source", F.lit("")).alias("schema_name"), F.col("doc_id").cast("string").alias("table_name"),
                    F.concat_ws(".", "source", F.col("doc_id").cast("string")).alias("slug"), F.coalesce("text", F.lit("")).alias("description"),
                    F.col("doc_id").cast("bigint").alias("pos"))
    return D.index_lines(ents).select("project", "k1", "k2.part", "k2.schema_name", "k2.table_name", "k2.pos", "k3", "line")


def notes_merge(spark, sf_dir):
    """Every text as a new body; labelled documents have an old body, of which
    the toxic ones lack notes."""
    new = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("slug"), F.coalesce("text", F.lit("")).alias("body"))
    note = F.concat(F.lit(f"old top\n{NOTES}\nquality "), F.col("quality").cast("string"), F.lit("\n \n"))
    old = read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("slug"), F.when(F.col("toxic") == 0, note).otherwise("no notes").alias("body"))
    return D.merge_notes(new, old)


_SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_FLAT = f"trim(regexp_replace(text, '{_SPACE}+', ' ', 'g'))"

_INDEX = f"""
WITH e AS (SELECT coalesce(lang, 'none') AS project, CASE WHEN n_chars > 1000 THEN 1 ELSE 2 END AS k1, source AS schema_name, CAST(doc_id AS VARCHAR) AS table_name,
             doc_id AS pos, {_FLAT} AS t FROM documents),
     i AS (SELECT *, CASE WHEN t = '' THEN '(no description)' WHEN strpos(t, '. ') > 0 THEN left(t, strpos(t, '. ')) WHEN strpos(t, '.') > 0 THEN left(t, strpos(t, '.')) ELSE t END AS s FROM e),
     h AS (SELECT DISTINCT project, k1 FROM e)
SELECT project, k1, 1 AS part, schema_name, table_name, pos, 0 AS k3, '- [`' || schema_name || '.' || table_name || '`](./' || schema_name || '.' || table_name || '.md) — ' || s AS line FROM i
UNION ALL SELECT project, 0, 0, NULL, NULL, NULL, k.k3, k.line FROM (SELECT DISTINCT project FROM e),
  (VALUES (0, '# Schema index'), (1, ''), (2, 'One file per table/source. Grep or Read directly — no scripts needed.'), (3, '')) AS k(k3, line)
UNION ALL SELECT project, k1, 0, NULL, NULL, NULL, 0, CASE k1 WHEN 1 THEN '## Models' ELSE '## Sources' END FROM h
UNION ALL SELECT project, k1, 0, NULL, NULL, NULL, 1, '' FROM h
UNION ALL SELECT project, k1, 2, NULL, NULL, NULL, 0, '' FROM h
"""

_NOTES = f"""
SELECT CAST(d.doc_id AS VARCHAR) AS slug, regexp_replace(coalesce(d.text, ''), '{_SPACE}+\\z', '') || chr(10) || chr(10) || '{NOTES}' || chr(10)
  || CASE WHEN l.toxic = 0 THEN 'quality ' || l.quality || chr(10) ELSE '' END AS body
FROM documents d LEFT JOIN labels l USING (doc_id)
"""

# ─── catalog entries ────────────────────────────────────────────────────────


def catalog_entry_lines(spark, sf_dir):
    """Every part as an entry of a table catalog: fields of each type in
    declared order."""
    p = read_table(spark, sf_dir, "part")
    spec = F.to_json(F.struct(
        F.col("p_size").alias("seats_included"), F.concat(F.lit(" A "), "p_name", F.lit(". ")).alias("description"), (F.col("p_size") > 25).alias("deprecated"),
        F.array("p_brand", "p_type").alias("tags"), F.struct(F.col("p_type").alias("type"), F.lit(" ").alias("blank"), F.col("p_size").alias("size")).alias("limits"),
        F.lit("  ").alias("nothing")))
    e = p.select(F.col("p_partkey"), F.col("p_partkey").cast("string").alias("name"), F.from_json(spec, N.ENTRY_MAP).alias("spec"))
    return N.entry_lines(e).select("p_partkey", F.array_join("lines", "\n").alias("body"))


_ENTRIES = """
SELECT p_partkey, concat_ws(chr(10), '### `' || p_partkey || '`', '', 'A ' || p_name || '.', '', '**Seats included:** ' || p_size,
  '', '**Deprecated:** ' || CASE WHEN p_size > 25 THEN 'yes' ELSE 'no' END, '', '**Tags:**', '- ' || p_brand, '- ' || p_type,
  '', '**Limits:**', '- `blank`', '- `size` — ' || p_size, '- `type` — ' || p_type) AS body FROM part
"""

# ─── manifests ──────────────────────────────────────────────────────────────


def _manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(project, value)``: the lines of five projects' manifests in order.
    Parts are models, order lines are tests, suppliers are sources. The rows are
    put in order before they become JSON, many tasks to a project."""
    def row(df, key, k1, k2, k3, *columns):
        return df.select((key % 5).cast("string").alias("project"), F.lit(k1).alias("k1"), k2.cast("bigint").alias("k2"), k3.cast("bigint").alias("k3"), *columns)

    def text(node_id, node, first=F.lit(False)):
        return F.concat(F.when(first, "").otherwise(","), node_id, F.lit(": "), F.to_json(node))

    c, lit, cat = F.col, F.lit, F.concat
    part, line, sup = (read_table(spark, sf_dir, t) for t in ("part", "lineitem", "supplier"))
    columns = F.struct(
        F.struct(c("p_type").alias("data_type"), cat(lit(" "), "p_name").alias("description"), F.parse_json(cat(lit('["unique", {"one_of": {"values": ['), "p_size", lit(', true]}}]'))).alias("tests"),
                 F.struct((c("p_size") > 25).alias("pii")).alias("meta")).alias("k"),
        F.struct(lit("int").alias("data_type")).alias("user_email"))
    quoted = lambda prefix, *keys: cat(lit(f'"{prefix}'), *keys, lit('"'))
    # the keys that put a row in order are not carried twice
    models = row(part, c("p_partkey"), 1, c("p_partkey"), lit(0), "p_name", "p_brand", "p_type", "p_size")
    model = text(quoted("model.p.", "k2"), F.struct(
        lit("model").alias("resource_type"), cat(lit("part_"), "k2").alias("name"), cat(lit("m/part_"), "k2", lit(".sql")).alias("path"), F.when(c("p_size") >= 10, c("p_brand")).otherwise("").alias("schema"),
        c("p_name").alias("description"), cat(lit(" select "), "p_size", lit("\n")).alias("raw_code"), columns.alias("columns"),
        F.struct(F.array(cat(lit("model.p."), c("k2") + 5), lit("seed.none"), cat(lit("source.s."), "p_size")).alias("nodes")).alias("depends_on")))
    n, ref = c("k3"), cat(lit("{{ f(ref('part_"), "l_partkey", lit("')) }}"))
    tests = row(line, c("l_partkey"), 2, c("l_orderkey"), c("l_linenumber"), "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag")
    test = text(quoted("test.t.", "k2", lit("."), "k3"), F.struct(
        lit("test").alias("resource_type"), lit("t").alias("name"), F.when(n == 1, cat(lit("model.p."), "l_partkey")).when(n == 2, "").alias("attached_node"),
        F.when(c("l_linestatus") == "O", lit("k")).otherwise(lit("user_email")).alias("column_name"),
        F.struct(F.when(n >= 5, F.array(lit("macro.m"), cat(lit("source.s."), "l_suppkey"))).alias("nodes")).alias("depends_on"),
        F.struct(F.when(c("l_returnflag") == "A", lit("among")).otherwise(lit("not_null")).alias("name"), F.struct(
            F.when(n <= 3, ref).when(n <= 5, cat(lit("source('shop', 'sup_"), "l_suppkey", lit("')"))).alias("model"), lit("k").alias("column_name"),
            F.when(c("l_returnflag") == "A", F.array(n.cast("string"), lit("it's"))).alias("values"), F.when(n == 4, lit(True)).alias("strict")).alias("kwargs")).alias("test_metadata")))
    firsts = sup.groupBy((c("s_suppkey") % 5).alias("_p")).agg(F.min("s_suppkey").alias("_first"))
    sources = row(sup.join(firsts, c("s_suppkey") % 5 == c("_p")), c("s_suppkey"), 4, c("s_suppkey"), lit(0), "s_name", "s_nationkey", "_first")
    source = text(quoted("source.s.", "k2"), F.struct(
        lit("shop").alias("source_name"), F.when(c("s_nationkey") < 5, cat(lit("part_"), "k2")).otherwise(cat(lit("sup_"), "k2")).alias("name"),
        F.when(c("s_nationkey") < 5, "prod").alias("schema"), c("s_name").alias("description")), c("k2") == c("_first"))
    frame = part.select((c("p_partkey") % 5).cast("string").alias("project")).distinct().select("project", F.inline(F.array(
        F.struct(lit(0).alias("k1"), cat(lit('{"metadata": {"project_name": "p'), "project", lit('"}, "macros": {"macro.m": {"macro_sql": "{% macro m() %}\\"{}\\"{% endmacro %}"}}, "nodes": {"seed.p.first": {"resource_type": "seed"}')).alias("value")),
        F.struct(lit(3).alias("k1"), lit('}, "sources": {').alias("value")), F.struct(lit(5).alias("k1"), lit("}}").alias("value")))))
    rows = frame.select("project", "k1", lit(0).cast("bigint").alias("k2"), lit(0).cast("bigint").alias("k3"), "value")
    for df in (models, tests, sources):
        rows = rows.unionByName(df, allowMissingColumns=True)
    key = ["project", "k1", "k2", "k3"]
    value = F.when(c("k1") == 1, model).when(c("k1") == 2, test).when(c("k1") == 4, source).otherwise(c("value"))
    return rows.repartitionByRange(*key).sortWithinPartitions(*key).select("project", value.alias("value"))


_PARSED: dict = {}
#: Manifest entries that stand on a line, and in a file.
_ON_LINE, _IN_FILE = 16, 50_000


def _nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, sources) of the manifests, written as one JSON text a project, in
    parts, and read back by the manifest reader; both once an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PARSED:
        folder = shared_dir(spark, f"tabledocs/manifests/{uuid.uuid4().hex}")
        delete_at_end(spark, folder)
        # packed files are read whole, so each holds a bounded number of entries, of which some stand on a line
        value = F.concat("value", F.when(F.monotonically_increasing_id() % _ON_LINE == _ON_LINE - 1, "\n").otherwise(""))
        with shuffles_dropped(spark), _large(spark, sf_dir):
            (_manifest_lines(spark, sf_dir).withColumn("value", value).write.partitionBy("project")
             .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", " ").option("maxRecordsPerFile", _IN_FILE).text(folder))
        _PARSED[key] = tuple(df.withColumn("project", F.regexp_extract("project", "project=([0-9]+)$", 1)) for df in read_manifests(spark, f"{folder}/project=*/*.txt.gz", in_parts=True))
        delete_now(spark, folder)  # the parsed nodes are written
    return _PARSED[key]


@contextmanager
def _large(spark: SparkSession, sf_dir: str):
    """Shuffles of this many tests start with more partitions, scans are spread."""
    with shuffles_spread(spark, bytes_of(spark, (table_path(sf_dir, t) for t in ("part", "lineitem", "supplier")))), scans_spread(spark):
        yield


def _catalog(spark: SparkSession, sf_dir: str, compiled: DataFrame | None = None) -> G.Catalog:
    """The catalog with its columns and lineage worked out once and written, so that
    the shuffle files of all tests are gone before documents are made of them."""
    cat = G.build_catalog(*_nodes(spark, sf_dir), compiled=compiled)
    with _large(spark, sf_dir):
        return replace(cat, columns=materialize(cat.columns, "catalog-columns", large=True), lineage=materialize(cat.lineage, "catalog-lineage", large=True))


def _compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compiled files of the smallest parts, written under their names and read back."""
    root = shared_dir(spark, f"tabledocs/compiled/{uuid.uuid4().hex}")
    part = spread(read_table(spark, sf_dir, "part").select("p_partkey", "p_size")).where("p_size < 5")
    path = F.concat(F.lit("p"), F.col("p_partkey") % 5, F.lit("/models/m/part_"), "p_partkey", F.lit(".sql"))
    write_files(spark, part.select(path.alias("path"), F.concat(F.lit("\n compiled "), "p_size", F.lit("\n")).alias("text")), root)
    delete_at_end(spark, root)
    return read_compiled_sql(spark, root)


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier has a catalog of two entries for its table: of its own
    project, of every one, or (each seventh) of another."""
    key, sup = F.col("s_suppkey"), read_table(spark, sf_dir, "supplier")
    prod = F.col("s_nationkey") < 5
    project = F.when(key % 3 == 0, "").otherwise(F.when(key % 7 == 0, (key + 1) % 5).otherwise(key % 5).cast("string"))
    spec = F.struct(F.struct(F.concat(F.lit(" For "), "s_name", F.lit(". ")).alias("description"), F.col("s_nationkey").alias("price"), key.alias("seats_included")).alias("basic"),
                    F.struct(F.lit("x").alias("price"), (F.col("s_nationkey") > 12).alias("deprecated")).alias("pro"))
    decls = sup.select(key.cast("int").alias("decl_pos"), project.alias("project"), F.when(key % 2 == 0, "plans").otherwise("perks").alias("kind"), F.lit("").alias("title"),
                       F.concat(F.when(prod, "prod.part_").otherwise("public.sup_"), key).alias("table_slug"), F.lit("").alias("source"), F.lit("{}").alias("options"),
                       F.to_json(spec).alias("text"))
    return N.section_text(N.section_lines(catalog_entries(decls), {"plans": N.plans_kind()}))


def docs_full(spark, sf_dir):
    """Documents of all models and sources with columns, tests, catalog
    sections, parents and SQL, compiled where a file is there."""
    cat = _catalog(spark, sf_dir, _compiled(spark, sf_dir))
    with _large(spark, sf_dir):
        return materialize(D.entity_bodies(G.dedupe_by_slug(cat.entities), cat.columns, cat.lineage, sections=_sections(spark, sf_dir)), "docs", large=True)


def docs_incremental(spark, sf_dir):
    """A second build of all documents: parts of size 7 have another
    description, those of size 9 are gone, those of size 11 are new."""
    cat = _catalog(spark, sf_dir)
    size = read_table(spark, sf_dir, "part").select(F.concat(F.lit("model.p."), "p_partkey").alias("node_id"), "p_size")
    ents = G.dedupe_by_slug(cat.entities).join(size, "node_id", "left").withColumn("p_size", F.coalesce("p_size", F.lit(0)))
    other = F.when(F.col("p_size") == 7, "Another one.").otherwise(F.col("description"))
    with _large(spark, sf_dir):
        # both builds read the entities, columns and parents twice
        ents = materialize(ents, "doc-entities", large=True)
        before = I.build(ents.where("p_size <> 11").drop("p_size"), cat.columns, cat.lineage)
        after = I.build(ents.where("p_size <> 9").withColumn("description", other).drop("p_size"), cat.columns, cat.lineage, last=before.state)
    return after.rendered.unionByName(after.removed.withColumn("change", F.lit("removed")))


def docs_export(spark, sf_dir):
    """Every text exported as a file of its document's name, and read back."""
    folder = shared_dir(spark, f"tabledocs/export/{uuid.uuid4().hex}")
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    D.export_markdown(d.select(F.col("doc_id").cast("string").alias("slug"), F.coalesce("text", F.lit("")).alias("body")), folder)
    delete_at_end(spark, folder)
    return read_markdown_folder(spark, folder).select("name", F.sha2("text", 256).alias("sha256"))


def pii_tags(spark, sf_dir):
    """The documented columns of all projects with the tags that PII names get."""
    cols = G.build_catalog(*_nodes(spark, sf_dir)).columns
    return P.apply_tags(cols).select("project", "node_id", "name", "meta")


def pii_tag_counts(spark, sf_dir):
    cols = G.build_catalog(*_nodes(spark, sf_dir)).columns
    return D.run_counts(P.tag_pii(cols, table_col="node_id"))


def catalog_test_index(spark, sf_dir):
    """Declared tests with their owner, indexed by column."""
    idx = G.test_index(G.test_owners(*_nodes(spark, sf_dir)))
    return idx.withColumn("indexed", F.array_join("indexed", "\n"))


def catalog_lineage(spark, sf_dir):
    nodes, sources = _nodes(spark, sf_dir)
    return G.lineage(nodes.where("node.resource_type = 'model'"), nodes, sources)


def catalog_entities(spark, sf_dir):
    """Models and sources after the name filters, one per relation."""
    cat = G.build_catalog(*_nodes(spark, sf_dir), include=["part_", "sup_"], exclude=["part_1", "sup_2"])
    return G.dedupe_by_slug(cat.entities)


def catalog_columns(spark, sf_dir):
    """Documented columns with inline tests, then the indexed ones."""
    return _catalog(spark, sf_dir).columns.withColumn("tests", F.array_join("tests", "\n"))


def sample_refresh(spark, sf_dir):
    """Cache validity and refresh plan of every model and source; parts of
    some sizes have a stale cache, suppliers have none."""
    cat = G.build_catalog(*_nodes(spark, sf_dir))
    ents = G.dedupe_by_slug(cat.entities)
    fps = SM.entity_fingerprints(cat.columns)
    size = F.col("p_size")
    part = read_table(spark, sf_dir, "part")
    cached = part.select(
        (F.col("p_partkey") % 5).cast("string").alias("project"),
        F.concat(F.when(size >= 10, F.col("p_brand")).otherwise("prod"), F.lit(".part_"), F.col("p_partkey")).alias("slug"),
        F.when(size == 31, 2).otherwise(1).alias("version"), F.lit("").alias("schema_name"), F.lit("").alias("table_name"), F.lit("").alias("fetched_at"),
        SM.names_hash(F.when(size == 32, F.array(F.lit("k"))).otherwise(F.array(F.lit("user_email"), F.lit("k")))).alias("column_names_hash"),
        F.when(size == 33, "old").otherwise("rules").alias("obfuscation_hash"),
        F.array(F.struct(F.lit("user_email").alias("name"), F.lit("int").alias("data_type"), F.lit(True).alias("pii")),
                F.struct(F.lit("k").alias("name"), F.lit("int").alias("data_type"), (size > 20).alias("pii"))).alias("columns"),
        F.when(size != 34, F.array(F.create_map(F.lit("k"), F.lit("1")))).alias("rows"), F.array(F.lit("k")).alias("row_order"))
    plan = SM.refresh_plan(SM.cache_validity(ents, fps, cached, "rules"), refresh=["prod.part_7", ("3", "prod.part_8")])
    # a fetch of a relation that belongs to a model gives rows
    return SM.after_fetch(plan, ents.where("kind = 'model'")).select("project", "slug", "column_names_hash", "cache_valid", "action")


_OWNED = """
tests AS (
  SELECT CAST(l_partkey % 5 AS VARCHAR) AS project, l_linenumber AS n, 'model.p.' || l_partkey AS ref, p_partkey IS NOT NULL AS has_ref, 'source.s.' || l_suppkey AS src,
    s_suppkey IS NOT NULL AS has_src, CASE WHEN l_linestatus = 'O' THEN 'k' ELSE 'user_email' END AS column_name,
    CASE WHEN l_returnflag = 'A' THEN 'among(values=[' || l_linenumber || ', it''s]' || CASE WHEN l_linenumber = 4 THEN ', strict=true' ELSE '' END || ')'
         WHEN l_linenumber = 4 THEN 'not_null(strict=true)' ELSE 'not_null' END AS test_text
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 5 = l_partkey % 5 AND s_nationkey >= 5
), owned AS (
  SELECT project, column_name, test_text, CASE WHEN n = 1 THEN ref WHEN n <= 3 THEN CASE WHEN has_ref THEN ref END
    WHEN n = 4 THEN CASE WHEN has_src THEN src END ELSE src END AS node_id FROM tests
), idx AS (
  SELECT project, node_id, column_name, string_agg(test_text, chr(10) ORDER BY test_text) AS indexed FROM owned WHERE node_id IS NOT NULL GROUP BY ALL
)"""

_LINEAGE = """
SELECT CAST(p.p_partkey % 5 AS VARCHAR) AS project, 'model.p.' || p.p_partkey AS node_id, 0 AS pos, 'model.p.' || q.p_partkey AS parent_id,
  'part_' || q.p_partkey AS parent_name, q.p_name AS parent_description FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 5
UNION ALL
SELECT CAST(p_partkey % 5 AS VARCHAR), 'model.p.' || p_partkey, 2, 'source.s.' || s_suppkey,
  'source:' || CASE WHEN s_nationkey < 5 THEN 'part_' ELSE 'sup_' END || s_suppkey, s_name FROM part JOIN supplier ON s_suppkey = p_size AND s_suppkey % 5 = p_partkey % 5
"""

_ENTITIES = """
all_entities AS (
  SELECT CAST(p_partkey % 5 AS VARCHAR) AS project, 'model' AS kind, CASE WHEN p_size >= 10 THEN p_brand ELSE 'prod' END AS schema_name, 'part_' || p_partkey AS table_name,
    p_name AS description, 'select ' || p_size AS compiled_sql, 'model.p.' || p_partkey AS node_id, row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY p_partkey) AS pos, p_size FROM part
  UNION ALL
  SELECT CAST(s_suppkey % 5 AS VARCHAR), 'source', CASE WHEN s_nationkey < 5 THEN 'prod' ELSE 'public' END, CASE WHEN s_nationkey < 5 THEN 'part_' ELSE 'sup_' END || s_suppkey,
    s_name, NULL, 'source.s.' || s_suppkey, row_number() OVER (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey) - 1, NULL FROM supplier
)"""
_ONE = "QUALIFY row_number() OVER (PARTITION BY project, schema_name, table_name ORDER BY kind DESC, pos DESC) = 1"

_COLUMNS = f"""
WITH {_OWNED}, cols AS (
  SELECT CAST(p_partkey % 5 AS VARCHAR) AS project, 'model.p.' || p_partkey AS node_id, 0 AS pos, 'k' AS name, p_type AS data_type, p_name AS description,
    'unique' || chr(10) || 'one_of(values=[' || p_size || ', true])' AS inline, '{{"pii":' || (p_size > 25) || '}}' AS meta FROM part
  UNION ALL SELECT CAST(p_partkey % 5 AS VARCHAR), 'model.p.' || p_partkey, 1, 'user_email', 'int', '', NULL, '{{}}' FROM part
)
SELECT project, node_id, pos, name, data_type, description, concat_ws(chr(10), inline, indexed) AS tests, meta
FROM cols LEFT JOIN (SELECT project, node_id, column_name AS name, indexed FROM idx) USING (project, node_id, name)
"""

_REFRESH = f"""
WITH {_ENTITIES}, e AS (SELECT * FROM all_entities {_ONE}),
c AS (SELECT CAST(p_partkey % 5 AS VARCHAR) AS project, CASE WHEN p_size >= 10 THEN p_brand ELSE 'prod' END || '.part_' || p_partkey AS slug, p_size AS size FROM part),
v AS (SELECT e.project, schema_name || '.' || table_name AS slug, kind, CASE WHEN kind = 'model' THEN 'sha256:' || sha256('["k", "user_email"]') END AS column_names_hash,
  kind = 'model' AND c.size IS NOT NULL AND c.size NOT IN (31, 32, 33, 34) AND (c.size > 20) = (c.size > 25) AS cache_valid
  FROM e LEFT JOIN c ON c.project = e.project AND c.slug = schema_name || '.' || table_name)
SELECT project, slug, column_names_hash, cache_valid, CASE WHEN cache_valid AND NOT (slug = 'prod.part_7' OR (project = '3' AND slug = 'prod.part_8')) THEN 'reuse'
  WHEN kind = 'model' THEN 'use_new' ELSE 'none' END AS action FROM v
"""


_FIRST = "CASE WHEN {0} = '' THEN '(no description)' WHEN strpos({0}, '. ') > 0 THEN left({0}, strpos({0}, '. ')) WHEN strpos({0}, '.') > 0 THEN left({0}, strpos({0}, '.')) ELSE {0} END"
_FULL = f"""
WITH {_OWNED}, {_ENTITIES}, e AS (SELECT * FROM all_entities {_ONE}),
cols AS ({_COLUMNS.split("cols AS (", 1)[1].split(")\nSELECT", 1)[0]}),
col_lines AS (
  SELECT project, node_id, string_agg('### ' || name || chr(10) || '- Type: `' || data_type || '`' || CASE WHEN description <> '' THEN chr(10) || chr(10) || description || chr(10) ELSE '' END
      || CASE WHEN coalesce(inline, indexed) IS NOT NULL THEN chr(10) || '- Tests: ' || replace(concat_ws(chr(10), inline, indexed), chr(10), ', ') ELSE '' END || chr(10), chr(10) ORDER BY pos) AS cl
  FROM cols LEFT JOIN (SELECT project, node_id, column_name AS name, indexed FROM idx) USING (project, node_id, name) GROUP BY project, node_id
), parents AS (
  SELECT project, node_id, string_agg('- `' || parent_name || '` — ' || {_FIRST.format("parent_description")}, chr(10) ORDER BY pos) AS pl FROM ({_LINEAGE}) GROUP BY project, node_id
), sections AS (
  SELECT CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 7 = 0 THEN CAST((s_suppkey + 1) % 5 AS VARCHAR) ELSE CAST(s_suppkey % 5 AS VARCHAR) END AS of_project,
    CASE WHEN s_nationkey < 5 THEN 'prod.part_' ELSE 'public.sup_' END || s_suppkey AS slug, CASE WHEN s_suppkey % 2 = 0 THEN 'plans' ELSE 'perks' END AS cat_kind,
    concat_ws(chr(10), CASE WHEN s_suppkey % 2 = 0 THEN '## Plans' ELSE '## Perks' END, '',
      CASE WHEN s_suppkey % 2 = 0 THEN concat_ws(chr(10), 'At a glance:', '', '| Tier | Price | Seats |', '| --- | --- | --- |', '| `basic` | ' || s_nationkey || ' | ' || s_suppkey || ' |', '| `pro` | x | — |', '') END,
      '### `basic`', '', 'For ' || s_name || '.', '', '**Price:** ' || s_nationkey, '', '**Seats included:** ' || s_suppkey,
      '### `pro`', '', '**Price:** x', '', '**Deprecated:** ' || CASE WHEN s_nationkey > 12 THEN 'yes' ELSE 'no' END,
      CASE WHEN s_suppkey % 2 = 0 AND s_nationkey > 12 THEN chr(10) || '> **Deprecated** — new signups are not allowed.' || chr(10) END) AS section
  FROM supplier
), bodies AS (
  SELECT e.project, schema_name || '.' || table_name AS slug,
    concat_ws(chr(10), '# `' || schema_name || '.' || table_name || '` (' || CASE WHEN cat_kind IS NOT NULL THEN 'source — ' || cat_kind || ' catalog' ELSE kind END || ')', '',
      CASE WHEN description <> '' THEN description || chr(10) END,
      CASE WHEN cl IS NULL THEN '## Columns' || chr(10) || chr(10) || '_(No columns documented.)_' || chr(10) ELSE '## Columns' || chr(10) || chr(10) || cl END,
      section, CASE WHEN pl IS NOT NULL THEN '## Parents' || chr(10) || chr(10) || pl || chr(10) END,
      CASE WHEN kind = 'model' THEN '## Compiled SQL' || chr(10) || chr(10) || '```sql' || chr(10) || CASE WHEN p_size < 5 THEN 'compiled ' || p_size ELSE compiled_sql END || chr(10) || '```' END) AS body
  FROM e LEFT JOIN col_lines USING (project, node_id) LEFT JOIN parents USING (project, node_id)
  LEFT JOIN sections s ON s.slug = schema_name || '.' || table_name AND (of_project = e.project OR of_project = '')
)
SELECT project, slug, rtrim(body, chr(10) || ' ') || chr(10) AS body FROM bodies
"""


def jobs() -> dict:
    return {f.__name__: f for f in (audit_lines, audit_round_trip, audit_rollup, audit_days, event_extract, docs_index, notes_merge, catalog_entry_lines,
                                    catalog_test_index, catalog_lineage, catalog_entities, catalog_columns, sample_refresh, docs_full, docs_incremental, docs_export, pii_tags, pii_tag_counts)}


def oracles() -> dict[str, str]:
    read = "ts, event, tool, sql_hash, reason, row_count, cache_hit, elapsed_ms, event_id"
    return {
        "audit_lines": "SELECT 'ts=' || CAST(ts AS BIGINT) || '.000 event=' || event || ' tool=\"run query\" sql_hash=' || sql_hash "
                       "|| CASE WHEN reason IS NULL THEN '' ELSE ' reason=\"has \\\"a=b\\\" in it\"' END || CASE WHEN row_count IS NULL THEN '' ELSE ' row_count=' || row_count END "
                       f"|| ' cache_hit=' || CASE WHEN cache_hit THEN 'True' ELSE 'False' END || ' elapsed_ms=' || elapsed_ms || ' event_id=' || event_id AS line FROM {_AUDIT}",
        "audit_round_trip": f"SELECT {read}, fmt FROM {_AUDIT}, (VALUES ('kv'), ('json')) AS f(fmt)",
        "audit_rollup": "SELECT sql_hash, count(*) AS calls, count(*) FILTER (event = 'tool_call_rejected') AS rejected, "
                        "avg(cache_hit::INT) FILTER (event = 'tool_call_ok') AS cache_hit_share, CAST(sum(row_count) FILTER (event = 'tool_call_ok') AS BIGINT) AS rows, "
                        "quantile_cont(elapsed_ms::DOUBLE, 0.5) FILTER (event = 'tool_call_ok') AS p50_ms, quantile_cont(elapsed_ms::DOUBLE, 0.95) FILTER (event = 'tool_call_ok') AS p95_ms "
                        f"FROM {_AUDIT} GROUP BY sql_hash",
        "audit_days": "SELECT sql_hash, count(*) AS calls, count(*) FILTER (event = 'tool_call_rejected') AS rejected, "
                      "avg(cache_hit::INT) FILTER (event = 'tool_call_ok') AS cache_hit_share, CAST(sum(row_count) FILTER (event = 'tool_call_ok') AS BIGINT) AS rows, "
                      "CASE WHEN count(elapsed_ms) FILTER (event = 'tool_call_ok') > 0 THEN true END AS p50_within, "
                      f"CASE WHEN count(elapsed_ms) FILTER (event = 'tool_call_ok') > 0 THEN true END AS p95_within FROM {_AUDIT} GROUP BY sql_hash",
        "event_extract": "SELECT event_id, ts, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing FROM events WHERE event_type = 'purchase'",
        "docs_index": _INDEX,
        "notes_merge": _NOTES,
        "catalog_entry_lines": _ENTRIES,
        "catalog_test_index": f"WITH {_OWNED} SELECT * FROM idx",
        "catalog_lineage": _LINEAGE,
        "catalog_entities": f"WITH {_ENTITIES} SELECT project, kind, schema_name, table_name, schema_name || '.' || table_name AS slug, description, compiled_sql, node_id, pos FROM all_entities "
                            f"WHERE NOT starts_with(table_name, 'part_1') AND NOT starts_with(table_name, 'sup_2') {_ONE}",
        "catalog_columns": _COLUMNS,
        "sample_refresh": _REFRESH,
        "docs_full": _FULL,
        "docs_incremental": f"WITH {_ENTITIES}, e AS (SELECT * FROM all_entities {_ONE}) SELECT project, schema_name || '.' || table_name AS slug, "
                            "CASE p_size WHEN 7 THEN 'changed' WHEN 9 THEN 'removed' ELSE 'new' END AS change FROM e WHERE p_size IN (7, 9, 11)",
        "docs_export": "SELECT CAST(doc_id AS VARCHAR) AS name, sha256(coalesce(text, '')) AS sha256 FROM documents",
        "pii_tags": "SELECT CAST(p_partkey % 5 AS VARCHAR) AS project, 'model.p.' || p_partkey AS node_id, c.name, "
                    "CASE WHEN c.name = 'user_email' THEN '{\"pii\":true}' ELSE '{\"pii\":' || (p_size > 25) || '}' END AS meta FROM part, (VALUES ('k'), ('user_email')) AS c(name)",
        "pii_tag_counts": "SELECT 'tagged' AS status, count(*) AS count FROM part",
    }
