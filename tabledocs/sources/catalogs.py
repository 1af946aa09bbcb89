"""Table-catalog source: ``{name: spec}`` files bound to a table.

Files are read whole (one row per file, many files in parallel). JSON is
parsed by ``from_json`` into ``map<string,variant>``, which keeps the declared
key order and each value's type. YAML goes through ``yaml.safe_load`` per
file in an Arrow batch (the only Python step) and is re-emitted as JSON.
A missing file is skipped with a warning.
"""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import file_path, file_uri

log = logging.getLogger(__name__)

CATALOG_SCHEMA = ("decl_pos int, project string, kind string, title string, table_slug string, source string, "
                  "options string, text string")
ENTRY_MAP = "map<string,variant>"


@dataclass
class CatalogDecl:
    kind: str
    source: str          # file path or inline text
    table: str = ""
    title: str = ""
    options: dict | None = None   # kind-specific options (column, data_column, ...)
    project: str = ""             # of one project; empty: of every project


def _yaml_to_json(text: str | None) -> str | None:
    import yaml
    if text is None:
        return None
    data = yaml.safe_load(text)
    return json.dumps(data if data is not None else {}, default=str)


def _to_json_text(df: DataFrame) -> DataFrame:
    """YAML or JSON text → JSON text, one file per row, in Arrow batches."""
    def conv(batches):
        for pdf in batches:
            pdf = pdf.copy()
            pdf["text"] = [_yaml_to_json(t) for t in pdf["text"]]
            yield pdf
    return df.mapInPandas(conv, df.schema)


def catalogs_from_decls(spark: SparkSession, decls: list[CatalogDecl], inline: bool = False
                        ) -> DataFrame:
    """Catalog rows ``(decl_pos, project, kind, title, table_slug, source, options,
    text)`` with ``options`` (of the declaration, for its kind's hooks) and
    ``text`` as JSON. With ``inline=True`` the ``source`` of each declaration
    is the text itself (converted on the driver, where it already is)."""
    rows = []
    paths = []
    for i, d in enumerate(decls):
        if inline:
            # inline text is already on the driver: convert it here
            rows.append((i, d.project, d.kind, d.title, d.table or "", "<inline>", json.dumps(d.options or {}), _yaml_to_json(d.source)))
        elif (uri := file_uri(spark, d.source)) is None:
            log.warning("catalog source not found: %s — skipping", d.source)
        else:
            paths.append((i, d, uri))
    df = spark.createDataFrame(rows, CATALOG_SCHEMA)
    if paths:
        files = (spark.read.text(list(dict.fromkeys(d.source for _, d, _ in paths)), wholetext=True)
                 .select(file_path().alias("path"), F.col("value").alias("text")))
        meta = spark.createDataFrame(
            [(i, d.project, d.kind, d.title, d.table or "", json.dumps(d.options or {}), uri) for i, d, uri in paths],
            "decl_pos int, project string, kind string, title string, table_slug string, options string, path string")
        found = meta.join(files, "path").withColumnRenamed("path", "source").select(*df.columns)
        # JSON files parse as they are; YAML goes through the Arrow-batch step
        is_json = F.lower(F.col("source")).endswith(".json")
        df = df.unionByName(found.where(is_json)).unionByName(_to_json_text(found.where(~is_json)))
    return df


def catalog_entries(catalogs: DataFrame) -> DataFrame:
    """One row per entry: ``(decl_pos, project, kind, title, table_slug, source, options, name,
    spec)``; ``spec`` is ``map<string,variant>`` in declared order. A catalog
    without entries is one row whose name is null: it still is its table's
    catalog if it is the last one."""
    # Two map levels, so both the entry order and each spec's field order are
    # kept (a variant object would sort its keys).
    m = F.from_json(F.col("text"), "map<string," + ENTRY_MAP + ">")
    project = F.coalesce("project", F.lit("")) if "project" in catalogs.columns else F.lit("")
    return (catalogs.select("decl_pos", project.alias("project"), "kind", "title", "table_slug", "source", "options",
                            F.posexplode_outer(m).alias("file_pos", "name", "v"))
            .select("decl_pos", "project", "kind", "title", "table_slug", "source", "options", "file_pos", "name",
                    F.coalesce(F.col("v"), F.create_map().cast(ENTRY_MAP)).alias("spec")))
