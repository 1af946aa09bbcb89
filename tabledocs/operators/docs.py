"""One document per entity, the index, and hand-written notes kept across
rebuilds.

Each part of a document is a line table ``(project, slug, k1, k2, k3,
line)``; the parts are unioned and each entity's lines are joined in key
order. A group holds one entity's lines, so its size is bounded by that
entity's metadata, never by table data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import (COLUMN_HEADING, COLUMN_TESTS, COLUMN_TYPE, COLUMNS_HEADING, DOC_HEADER,
                               INDEX_BLURB, INDEX_LINE, INDEX_MODELS, INDEX_SOURCES, INDEX_TITLE,
                               LABEL_CATALOG, LABEL_MODEL, LABEL_SOURCE, MANUAL_MARKER, NO_COLUMNS,
                               NO_DESCRIPTION, PARENT_LINE, PARENTS_HEADING, SAMPLES_HEADING,
                               SQL_FENCE_CLOSE, SQL_FENCE_OPEN, SQL_HEADING, TESTS_SEPARATOR)
from ..functions.strings import first_sentence_or, py_rstrip, py_strip, split_lines, template

def _empty() -> Column:
    return F.array().cast("array<string>")


def _lines(df: DataFrame, k1: int, k2: Column, arr: Column) -> DataFrame:
    return df.select("project", "slug", F.lit(k1).alias("k1"), k2.cast("long").alias("k2"),
                     F.posexplode(arr).alias("k3", "line"))


def _ordered(arr_of_pos_lines: Column) -> Column:
    """``array<struct<pos, lines>>`` → the lines, flattened in ``pos`` order."""
    return F.flatten(F.transform(F.sort_array(arr_of_pos_lines), lambda x: x.getField("lines")))


def column_lines(columns: DataFrame) -> Column:
    """Lines of one documented column (expression over a ``columns`` row)."""
    cdesc = F.coalesce(F.col("description"), F.lit(""))
    desc_lines = F.transform(split_lines(cdesc), lambda l: F.when(py_strip(l) == "", F.lit("")).otherwise(l))
    return F.concat(
        F.array(template(COLUMN_HEADING, name=F.col("name"))),
        F.when(F.coalesce(F.col("data_type"), F.lit("")) != "",
               F.array(template(COLUMN_TYPE, data_type=F.col("data_type")))).otherwise(_empty()),
        F.when(cdesc != "", F.concat(F.array(F.lit("")), desc_lines, F.array(F.lit("")))).otherwise(_empty()),
        F.when(F.coalesce(F.size("tests"), F.lit(0)) > 0,
               F.array(template(COLUMN_TESTS, tests=F.array_join("tests", TESTS_SEPARATOR)))).otherwise(_empty()),
        F.array(F.lit("")))


def entity_bodies(entities: DataFrame, columns: DataFrame, lineage: DataFrame,
                  sections: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """``(project, slug, body)`` per entity, sections in order: header,
    description, columns, catalog section, parents, sample rows, SQL.

    Each part is one aggregate per entity (lines with their position), joined
    once to the entities; the body is then a single projection. Every group
    holds one entity's metadata only."""
    cols = columns.groupBy("project", "node_id").agg(
        _ordered(F.collect_list(F.struct(F.col("pos"), column_lines(columns).alias("lines")))).alias("_cols"))
    par_line = template(PARENT_LINE, name=F.col("parent_name"),
                        summary=first_sentence_or(F.col("parent_description"), NO_DESCRIPTION))
    pars = lineage.groupBy("project", "node_id").agg(
        _ordered(F.collect_list(F.struct(F.col("pos"), F.array(par_line).alias("lines")))).alias("_pars"))
    e = (entities.join(cols, ["project", "node_id"], "left")
         .join(pars, ["project", "node_id"], "left"))
    if samples is not None:
        smp = samples.groupBy("project", "slug").agg(
            F.max("n_rows").alias("_n"),
            _ordered(F.collect_list(F.struct(F.col("col_pos"), F.array("line").alias("lines")))).alias("_smp"))
        e = e.join(smp, ["project", "slug"], "left")
    else:
        e = e.withColumn("_n", F.lit(None).cast("int")).withColumn("_smp", _empty())
    if sections is not None:
        e = _with_sections(e, sections)
    else:
        e = e.withColumn("_cat_kind", F.lit(None).cast("string")).withColumn("_section", F.lit(None).cast("string"))

    label = F.when(F.col("_cat_kind").isNotNull(), template(LABEL_CATALOG, kind=F.col("_cat_kind"))
                   ).when(F.col("kind") == "model", F.lit(LABEL_MODEL)).otherwise(F.lit(LABEL_SOURCE))
    desc = py_strip(F.coalesce(F.col("description"), F.lit("")))
    sql = F.col("compiled_sql")
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    lines = F.concat(
        F.array(template(DOC_HEADER, slug=F.col("slug"), label=label), F.lit("")),
        F.when(desc != "", F.array(desc, F.lit(""))).otherwise(_empty()),
        F.when(has("_cols"), F.concat(F.array(F.lit(COLUMNS_HEADING), F.lit("")), F.col("_cols")))
        .otherwise(F.array(F.lit(NO_COLUMNS))),
        F.when(F.col("_section").isNotNull(), F.array(F.col("_section"))).otherwise(_empty()),
        F.when(has("_pars"), F.concat(F.array(F.lit(PARENTS_HEADING), F.lit("")), F.col("_pars"), F.array(F.lit(""))))
        .otherwise(_empty()),
        F.when(has("_smp"), F.concat(
            F.array(template(SAMPLES_HEADING, n=F.col("_n").cast("string")), F.lit("")),
            F.col("_smp"), F.array(F.lit("")))).otherwise(_empty()),
        F.when(F.coalesce(sql, F.lit("")) != "", F.array(
            F.lit(SQL_HEADING), F.lit(""), F.lit(SQL_FENCE_OPEN), sql, F.lit(SQL_FENCE_CLOSE), F.lit("")))
        .otherwise(_empty()))
    body = F.concat(py_rstrip(F.array_join(lines, "\n")), F.lit("\n"))
    return e.select("project", "slug", body.alias("body"))


def _with_sections(entities: DataFrame, sections: DataFrame) -> DataFrame:
    """Each entity with its catalog's kind and section: of its project's and of
    those for every project (empty ``project``), the one declared last."""
    s = sections if "project" in sections.columns else sections.withColumn("project", F.lit(""))
    s = s if "decl_pos" in s.columns else s.withColumn("decl_pos", F.lit(0))
    found = F.struct(F.col("decl_pos").alias("at"), F.col("kind").alias("kind"), F.col("section").alias("section"))
    own = s.where(F.col("project") != "").select("project", F.col("table_slug").alias("slug"), found.alias("_own"))
    shared = s.where(F.col("project") == "").select(F.col("table_slug").alias("slug"), found.alias("_shared"))
    e = entities.join(own, ["project", "slug"], "left").join(shared, "slug", "left")
    # a null struct is less than any other
    last = F.when(F.col("_shared").isNull() | (F.col("_own.at") > F.col("_shared.at")), F.col("_own")).otherwise(F.col("_shared"))
    return e.withColumn("_last", last).withColumns({"_cat_kind": F.col("_last.kind"), "_section": F.col("_last.section")})


def join_lines(lines: DataFrame, keys=("project", "slug")) -> DataFrame:
    """Lines → ``body``: joined with newlines in key order, trailing
    whitespace removed, one final newline."""
    g = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k1", "k2", "k3", "line"))).alias("ls"))
    body = F.array_join(F.transform("ls", lambda x: x.getField("line")), "\n")
    return g.select(*keys, F.concat(py_rstrip(body), F.lit("\n")).alias("body"))


def index_lines(entities: DataFrame) -> DataFrame:
    """Index per project as a line table ``(project, slug='_index', k1, k2,
    k3, line)``: models then sources, each sorted by schema and table, one
    summary line each; an empty section is left out. ``k2`` holds the place in
    the section, the schema, the table and the position, so ordering needs no
    ranking and the lines stay distributed; joining them into one text
    (``join_lines``) makes one group per project, whose size is the project's
    entity count (catalog metadata, about 100 bytes per entity), never table
    data."""
    e = entities
    summary = first_sentence_or(F.col("description"), NO_DESCRIPTION)
    k1 = F.when(F.col("kind") == "model", F.lit(1)).otherwise(F.lit(2))

    def place(part: int, named: bool = False) -> Column:
        pick = lambda c, t: (F.col(c) if named else F.lit(None)).cast(t).alias(c)
        return F.struct(F.lit(part).alias("part"), pick("schema_name", "string"), pick("table_name", "string"), pick("pos", "long"))

    slug = F.lit("_index").alias("slug")
    heads = e.select("project", "kind").distinct()
    top = e.select("project").distinct().select(
        "project", slug, F.lit(0).alias("k1"), place(0).alias("k2"),
        F.posexplode(F.array(F.lit(INDEX_TITLE), F.lit(""), F.lit(INDEX_BLURB), F.lit(""))).alias("k3", "line"))
    sec_label = F.when(F.col("kind") == "model", F.lit(INDEX_MODELS)).otherwise(F.lit(INDEX_SOURCES))
    sec = heads.select("project", slug, k1.alias("k1"), place(0).alias("k2"),
                       F.posexplode(F.array(sec_label, F.lit(""))).alias("k3", "line"))
    items = e.select("project", slug, k1.alias("k1"), place(1, True).alias("k2"), F.lit(0).alias("k3"),
                     template(INDEX_LINE, slug=F.col("slug"), summary=summary).alias("line"))
    tail = heads.select("project", slug, k1.alias("k1"), place(2).alias("k2"), F.lit(0).alias("k3"), F.lit("").alias("line"))
    return top.unionByName(sec).unionByName(items).unionByName(tail)


def merge_notes(new_docs: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Keep hand-written notes: everything from the marker line down in the
    existing body is appended to the new body; without an existing marker the
    empty marker block is appended. ``existing`` without a ``project`` column
    holds the documents of one project, or of slugs that no two share."""
    placeholder = F.lit(MANUAL_MARKER + "\n")
    if existing is None:
        preserved = placeholder
        j = new_docs
    else:
        keys = [k for k in ("project", "slug") if k in existing.columns and k in new_docs.columns]
        old = existing.select(*keys, F.col("body").alias("_old"))
        j = new_docs.join(old, keys, "left")
        idx = F.instr(F.coalesce(F.col("_old"), F.lit("")), F.lit(MANUAL_MARKER))
        preserved = F.when(idx > 0, F.concat(py_rstrip(F.substring(F.col("_old"), idx, 1 << 30)), F.lit("\n"))
                           ).otherwise(placeholder)
    return j.select(*[c for c in new_docs.columns if c != "body"],
                    F.concat(py_rstrip(F.col("body")), F.lit("\n\n"), preserved).alias("body"))


def write_docs(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Docs sink: the ``(project, slug, body)`` table as parquet (the shared form)."""
    docs.write.mode(mode).parquet(path)


def export_text(docs: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Docs as text through Spark's writer and output committer (any Hadoop
    file system; a retried task never leaves partial output): one folder per
    document, ``[project=<project>/]slug=<slug>/part-*.txt``, each holding that
    document's body; the project is there when the table has that column."""
    keys = [k for k in ("project", "slug") if k in docs.columns]
    # the writer ends each row with a newline; bodies already end with one
    body = F.regexp_replace("body", "\n\\z", "")
    (docs.select(*keys, body.alias("body")).repartition(*keys).write.mode(mode)
     .partitionBy(*keys).text(folder))


def export_markdown(docs: DataFrame, folder: str) -> None:
    """One ``<slug>.md`` per row, by the ``named_text`` writer: all files appear
    when the whole job has succeeded, and a killed task leaves none. Slugs
    with path separators are refused, and so are documents of one slug
    (of two projects): export each project to a folder of its own."""
    from ..sources.textfiles import write_files
    bad = docs.where(F.col("slug").isNull() | F.col("slug").rlike(r"[/\\\\]|\.\.")).select("slug").first()
    if bad:
        raise ValueError(f"a document can't be a file of this name: {bad.slug!r}")
    twice = docs.groupBy("slug").count().where("count > 1").select("slug").first()
    if twice:
        raise ValueError(f"more than one document of {twice.slug!r}: export each project to its own folder")
    write_files(docs.sparkSession, docs.select(F.concat("slug", F.lit(".md")).alias("path"), F.col("body").alias("text")), folder)


def build_docs(entities: DataFrame, columns: DataFrame, lineage: DataFrame,
               sections: DataFrame | None = None, samples: DataFrame | None = None,
               existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All entity documents (notes merged) and the index per project:
    ``(project, slug, body)`` each. ``entities`` should be deduplicated."""
    docs = entity_bodies(entities, columns, lineage, sections, samples)
    docs = merge_notes(docs, existing)
    index = join_lines(index_lines(entities))
    return docs, index


def run_counts(report: DataFrame, status_col: str = "status") -> DataFrame:
    """How many items ended in each status (entities written, columns tagged
    or already tagged, sample actions)."""
    return report.groupBy(status_col).count()
