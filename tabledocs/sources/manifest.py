"""Manifest source: many projects' ``manifest.json`` files read as tables.

Files are read by blocks (``manifest_split``), so one large manifest is shared out
among tasks and no task holds a whole one. Each node is parsed once by
``from_json`` with the declared DDL (extra keys ignored) as it is found, and only
the parsed nodes are written; every row carries its manifest position and ``project`` (the file
path), so a directory of manifests loads in one go. Manifests that are texts
in memory are parsed whole. A session-catalog source builds the
same tables from DataFrame schemas for users without manifests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import file_path, file_uri, materialize, scans_spread
from .manifest_split import placed, places, put_together, scan_entries
from .textfiles import read_files

COLUMN_DDL = ("map<string, struct<data_type:string, description:string, meta:string, "
              "tests:string, data_tests:string>>")
NODE_DDL = (
    "struct<resource_type:string, name:string, schema:string, "
    "description:string, path:string, raw_code:string, attached_node:string, "
    f"column_name:string, columns:{COLUMN_DDL}, depends_on:struct<nodes:array<string>>, "
    "test_metadata:struct<name:string, kwargs:map<string,variant>>>"
)
SOURCE_DDL = f"struct<source_name:string, name:string, schema:string, description:string, columns:{COLUMN_DDL}>"
MANIFEST_DDL = f"metadata struct<project_name:string>, nodes map<string, {NODE_DDL}>, sources map<string, {SOURCE_DDL}>"


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names anything, on any file system Spark reads."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hpath))


def _check_paths(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The paths as a list. A missing one is an error naming it."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    for p in paths:
        if not _exists(spark, p):
            raise FileNotFoundError(f"no manifest at {p}: compile the project before reading it")
    return paths


def read_manifest_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(project, value)``: one row per manifest file. A missing path is an
    error naming it."""
    return (spark.read.text(_check_paths(spark, paths), wholetext=True)
            .select(file_path().alias("project"), "value"))


def manifests_from_text(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """``(project, value)`` from in-memory ``(project, json_text)`` pairs."""
    return spark.createDataFrame(texts, "project string, value string")


def parse_manifests(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """→ ``(nodes, sources)``, one row per node with its manifest position.

    nodes:   project, project_name, pos, node_id, node (struct)
    sources: project, project_name, pos, node_id, node (struct)
    """
    m = raw.select("project", F.from_json("value", MANIFEST_DDL).alias("m"))
    m = m.select("project", F.col("m.metadata.project_name").alias("project_name"),
                 F.col("m.nodes").alias("nodes"), F.col("m.sources").alias("sources"))
    nodes = m.select("project", "project_name",
                     F.posexplode("nodes").alias("pos", "node_id", "node"))
    sources = m.select("project", "project_name",
                       F.posexplode("sources").alias("pos", "node_id", "node"))
    return nodes, sources


#: An entry whose key is plain and whose value is an object.
_PLAIN = r'^"([^"\\\x00-\x1f]*)"[ \t\r\n]*:[ \t\r\n]*\{'
_BAD = "_corrupt_record"
_DDL = {"nodes": NODE_DDL, "sources": SOURCE_DDL}


def _parsed(fragments: DataFrame) -> DataFrame:
    """Entries parsed, a column a section (null of others), with their ``node_id``;
    those that are cut, odd or metadata keep their text instead.

    The value is parsed by itself: keys differ from row to row, and the parser's
    table of field names, which grows with each new one, is copied for it."""
    plain = fragments.withColumn("_begin", F.when(F.col("whole") & F.col("section").isin(*_DDL), F.regexp_extract("text", _PLAIN, 0)))
    value = F.when(F.col("_begin") != "", F.substring("text", F.length("_begin"), F.lit(1 << 30)))
    one = plain.select("*", *[F.from_json(F.when(F.col("section") == s, value), f"{ddl[:-1]}, {_BAD}:string>", {"columnNameOfCorruptRecord": _BAD}).alias(s) for s, ddl in _DDL.items()])
    clean = {s: F.col(s).isNotNull() & F.col(f"{s}.{_BAD}").isNull() for s in _DDL}
    whole = reduce(Column.__or__, clean.values())
    return one.select("id", "section", "idx", "whole", F.when(~whole, F.col("text")).alias("text"), F.when(whole, F.regexp_extract("text", _PLAIN, 1)).alias("node_id"),
                      *[F.when(c, F.col(s).dropFields(_BAD)).alias(s) for s, c in clean.items()])


def read_manifests(spark: SparkSession, paths, in_parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """→ ``(nodes, sources)`` of manifest files, as :func:`parse_manifests` gives
    them; each file is read by blocks, each node parsed by the scan that finds it
    and written once. ``in_parts``: the files of each folder are one manifest
    (``read_entries``)."""
    paths = _check_paths(spark, paths)
    with scans_spread(spark):
        states, fragments = scan_entries(spark, paths, in_parts=in_parts)
        parts = materialize(_parsed(fragments), "manifest-entries", large=True)
        at = places(parts, states)
    # few entries, as a rule: a cut one a block, odd ones, metadata
    text = parts.where("text is not null")
    rest = materialize(placed(text.where("whole"), at).select("project", "section", "pos", "text").unionByName(put_together(text, at)), "manifest-rest")
    object_ = F.concat(F.lit("{"), "text", F.lit("}"))
    named = (rest.where("section = 'metadata'").select("project", F.get_json_object(object_, "$.project_name").alias("project_name"))
             .groupBy("project").agg(F.max("project_name").alias("project_name")))  # a row a manifest
    at = materialize(at.join(F.broadcast(named), "project", "left"), "manifest-places")

    def found(section: str) -> DataFrame:
        columns = ["project", "project_name", F.col("pos").cast("int").alias("pos"), "node_id"]
        clean = placed(parts.where((F.col("section") == section) & F.col("node_id").isNotNull()), at).select(*columns, F.col(section).alias("node"))
        odd = rest.where(F.col("section") == section)
        if not odd.head(1):
            return clean
        one = F.map_entries(F.from_json(object_, f"map<string, {_DDL[section]}>"))
        # of what isn't JSON no key is read; dropped afterwards, as a filter here would parse each entry twice
        odd = materialize(odd.join(F.broadcast(named), "project", "left").select(*columns[:3], F.inline_outer(one).alias("node_id", "node")), f"manifest-{section}")
        return clean.unionByName(odd.where("node_id is not null"))
    return found("nodes"), found("sources")


def read_compiled_sql(spark: SparkSession, compiled_root: str, manifest: str | None = None) -> DataFrame:
    """Compiled model files ``(project, project_name, path, text)`` where
    ``path`` is relative to ``<root>/<project_name>/models``. ``project`` is
    the ``manifest`` they belong to; without one, they are those of every
    manifest of that project name. Several checkouts: the union of their
    frames, each with its manifest. Empty when the folder is absent."""
    root = file_uri(spark, compiled_root)
    schema = "project string, project_name string, path string, text string"
    if root is None:
        return spark.createDataFrame([], schema)
    files, inside = read_files(spark, compiled_root, nested=True), F.col("path")
    if files is None:
        files = (spark.read.option("recursiveFileLookup", "true").text(compiled_root, wholetext=True)
                 .select(file_path().alias("fp"), F.col("value").alias("text")))
        # paths are encoded; a plus sign stands for itself in them
        inside = F.url_decode(F.replace(F.substring(F.col("fp"), len(root.rstrip("/")) + 2, 1 << 30), F.lit("+"), F.lit("%2B")))
    part = lambda g: F.regexp_extract(inside, r"^([^/]+)/models/(.*)$", g)
    return files.where(part(0) != "").select(
        F.lit(manifest and (file_uri(spark, manifest) or manifest)).cast("string").alias("project"), part(1).alias("project_name"), part(2).alias("path"), "text")


# ─── session catalog ────────────────────────────────────────────────────────

def entities_from_tables(spark: SparkSession, tables: dict[str, DataFrame], schema_name: str = "main",
                         project: str = "session") -> tuple[DataFrame, DataFrame]:
    """``entities`` and ``columns`` for DataFrames without a manifest: one
    source entity per table, columns in schema order with their Spark type
    and any ``pii`` flag from field metadata. Schemas are metadata, read on
    the driver."""
    import json
    ents, cols = [], []
    for i, (name, df) in enumerate(tables.items()):
        node_id = f"source.{project}.{schema_name}.{name}"
        ents.append((project, "source", schema_name, name, f"{schema_name}.{name}", "", None, node_id, i))
        for pos, f in enumerate(df.schema.fields):
            meta = json.dumps({"pii": True}) if f.metadata.get("pii") is True else "{}"
            desc = str(f.metadata.get("comment", "") or "")
            cols.append((project, node_id, pos, f.name, f.dataType.simpleString(), desc, [], meta))
    e = spark.createDataFrame(ents, ENTITY_SCHEMA)
    c = spark.createDataFrame(cols, COLUMN_SCHEMA)
    return e, c


ENTITY_SCHEMA = ("project string, kind string, schema_name string, table_name string, slug string, "
                 "description string, compiled_sql string, node_id string, pos long")
COLUMN_SCHEMA = ("project string, node_id string, pos int, name string, data_type string, "
                 "description string, tests array<string>, meta string")
