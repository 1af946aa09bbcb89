"""Files of exact names: staged by tasks, moved when the job commits."""
import os

import pytest
from pyspark.sql import functions as F

from tabledocs.operators import docs as D
from tabledocs.operators import entries as N
from tabledocs.sources import textfiles as X
from tabledocs.sources.catalogs import CatalogDecl, catalog_entries, catalogs_from_decls
from tabledocs.sources.corpus import read_markdown_folder


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_export_through_paths_and_uris(spark, tmp_path, scheme):
    rows = [("a.b", "é\n\nbody\n"), ("_index", "index"), ("x y", ""), ("n", None)]
    docs = spark.createDataFrame(rows, "slug string, body string").repartition(3)
    folder = scheme + str(tmp_path / "out")
    D.export_markdown(docs, folder)
    D.export_markdown(docs.where("slug = 'a.b'").withColumn("body", F.lit("new")), folder)
    assert sorted(os.listdir(tmp_path / "out")) == ["_index.md", "a.b.md", "n.md", "x y.md"]
    assert {r.name: r.text for r in read_markdown_folder(spark, folder).collect()} == {"a.b": "new", "x y": "", "n": ""} or \
        {r.name: r.text for r in read_markdown_folder(spark, folder).collect()} == {"a.b": "new"}


def test_failed_job_leaves_nothing(spark, tmp_path):
    """A row that can't be written ends the job: no file of it, the old ones as they were."""
    folder = str(tmp_path / "out")
    X.write_files(spark, spark.createDataFrame([("a.md", "old")], "path string, text string"), folder)
    bad = spark.createDataFrame([(f"f{i}.md", "x") for i in range(50)] + [("../evil", "x"), ("a.md", "new")], "path string, text string").repartition(8)
    with pytest.raises(Exception, match="can't be a file"):
        X.write_files(spark, bad, folder)
    assert os.listdir(folder) == ["a.md"] and (tmp_path / "out" / "a.md").read_text() == "old"
    assert not (tmp_path / "evil").exists()


def test_only_committed_attempts_count(tmp_path, monkeypatch):
    """Two attempts of one task, the first killed on its way: files of the second alone."""
    from pyspark import TaskContext

    class Task:
        attempt = 0

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            Task.attempt += 1
            return Task.attempt
    monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: Task()))
    writer = X._Writer(f"file://{tmp_path}")

    def killed():
        yield {"path": "d/one.md", "text": "half"}
        raise InterruptedError
    with pytest.raises(InterruptedError):
        writer.write(killed())
    done = writer.write(iter([{"path": "d/one.md", "text": "whole"}, {"path": "two.md", "text": None}]))
    assert not (tmp_path / "d").exists()
    writer.commit([done, None])
    assert sorted(os.listdir(tmp_path)) == ["d", "two.md"] and (tmp_path / "d" / "one.md").read_text() == "whole"
    for name in ("", "/x", "a//b", "a/../b", "a\\b", None):
        with pytest.raises(ValueError):
            X.check_name(name)


def test_names_that_leave_the_folder_or_repeat(spark, tmp_path):
    for slugs, say in ((["a/b"], "can't be a file"), (["a..b"], "can't be a file"), (["a", "a"], "more than one")):
        with pytest.raises(ValueError, match=say):
            D.export_markdown(spark.createDataFrame([(s, "x") for s in slugs], "slug string, body string"), str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_sections_of_projects(spark):
    """Two projects with one slug have catalogs of their own; the last declared of those that apply counts."""
    decls = [CatalogDecl("perks", "{a: {x: 1}}", "s.t", project="p1"), CatalogDecl("perks", "{a: {x: 2}}", "s.t", project="p2"),
             CatalogDecl("flags", "{b: {}}", "s.u"), CatalogDecl("perks", "{c: {}}", "s.u", project="p1"), CatalogDecl("flags", "{d: {}}", "s.v", project="p1"), CatalogDecl("late", "{}", "s.v")]
    sections = N.section_text(N.section_lines(catalog_entries(catalogs_from_decls(spark, decls, inline=True)), {}))
    ents = spark.createDataFrame([(p, "model", "s", t, f"s.{t}", "", None, f"{p}.{t}", 0) for p in ("p1", "p2", "p3") for t in "tuv"],
                                 "project string, kind string, schema_name string, table_name string, slug string, description string, compiled_sql string, node_id string, pos long")
    cols = spark.createDataFrame([], "project string, node_id string, pos int, name string, data_type string, description string, tests array<string>, meta string")
    lin = spark.createDataFrame([], "project string, node_id string, pos long, parent_id string, parent_name string, parent_description string")
    got = {(r.project, r.slug): r.body for r in D.entity_bodies(ents, cols, lin, sections).collect()}
    assert len(got) == 9
    assert "**X:** 1" in got["p1", "s.t"] and "**X:** 2" in got["p2", "s.t"] and "(model)" in got["p3", "s.t"]
    assert "### `c`" in got["p1", "s.u"] and "### `b`" in got["p2", "s.u"] and "### `b`" in got["p3", "s.u"]
    assert all("late catalog" in got[p, "s.v"] and "###" not in got[p, "s.v"] for p in ("p1", "p2", "p3"))


def test_hooks_without_a_project(spark):
    entries = catalog_entries(catalogs_from_decls(spark, [CatalogDecl("k", "{a: {}}", "s.t", project=p) for p in ("p1", "p2")], inline=True))
    kind = N.Kind(intro=lambda e: e.select("table_slug", F.lit(0).alias("pos"), F.lit("intro").alias("line")).distinct())
    got = {r.project: r.section for r in N.section_text(N.section_lines(entries, {"k": kind})).collect()}
    assert got == {"p1": "## K\n\nintro\n\n### `a`", "p2": "## K\n\nintro\n\n### `a`"}


def _spark_reader(spark, folder, **options):
    return spark.read.options(**options).text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.sha2("value", 256).alias("sha")).collect()


def test_many_files_by_few_tasks(spark, tmp_path, monkeypatch):
    """Files are moved and read by tasks in number bounded by the cores, not by the files, from lists of bounded length."""
    def on_driver(*a):
        raise AssertionError("the driver moves files")
    folder, n, tasks = str(tmp_path / "out"), 1500, X._TASKS * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(X, "_LISTED", 100)
    rows = spark.range(n, numPartitions=2).select(F.concat("id", F.lit(".md")).alias("path"), F.concat(F.lit("text "), "id").alias("text"))
    X.write_files(spark, rows, folder)
    assert len(os.listdir(folder)) == n
    monkeypatch.setattr(X, "_move_list", on_driver)
    X.write_files(spark, rows, folder)
    read = read_markdown_folder(spark, folder)
    assert read.rdd.getNumPartitions() <= tasks < spark.read.text(folder, wholetext=True).rdd.getNumPartitions()
    assert {(r.name, r.text) for r in read.collect()} == {(str(i), f"text {i}") for i in range(n)} and read.count() == n


def test_moves_go_on_where_an_attempt_ended(tmp_path):
    fs, root = X.open_folder(str(tmp_path))
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "0.json").write_text('["d/a", "b", "c"]')
    for i in (1, 2):
        (tmp_path / "s" / f"0-{i}").write_text(str(i))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a").write_text("moved before")
    assert X._move_list(fs, root, "s", 0) == 3
    assert [(tmp_path / x).read_text() for x in ("d/a", "b", "c")] == ["moved before", "1", "2"]
    (tmp_path / "s" / "1.json").write_text('["lost"]')
    with pytest.raises(OSError):
        X._move_list(fs, root, "s", 1)


def test_folders_are_read_as_by_spark(spark, tmp_path):
    """Odd names, hidden, empty and broken files give the rows of Spark's own reader."""
    odd = {"a b+%20.md": b"1", "\u00fc\u20ac.md": b"2", "_x.md": b"3", "_x=1.md": b"4", ".y.md": b"5", "z.md._COPYING_": b"6", "_metadata.md": b"7", "empty.md": b"",
           "raw.md": b"\xff\xfe\x00caf\xe9", "bom.md": b"\xef\xbb\xbfx\r\n", "other.txt": b"8", "_index.md": b"9", "a.md.gz": b"10", "".join(map(chr, range(1, 47))) + ".md": b"11",
           "".join(map(chr, range(59, 180))).replace("\\", "") + "\u3000.md": b"12"}
    flat = tmp_path / "a b%41"
    flat.mkdir()
    for name, data in odd.items():
        (flat / name).write_bytes(data)
    (flat / "broken.md").symlink_to(tmp_path / "nowhere")
    got = [(r.shown, r.sha) for r in X.read_files(spark, str(flat), suffix=".md").select("shown", F.sha2("text", 256).alias("sha")).collect()]
    assert sorted(got) == sorted((r.name, r.sha) for r in _spark_reader(spark, str(flat), pathGlobFilter="*.md")) and len(got) > 4
    # other stores, patterns, folders by partition and packed files are left to Spark's reader
    assert X.read_files(spark, f"{tmp_path}/*", suffix=".md") is None and X.read_files(spark, str(tmp_path / "none")) is None
    assert X.read_files(spark, str(flat)) is None and X.read_files(spark, str(flat / "raw.md")) is None
    (tmp_path / "parted" / "p=1").mkdir(parents=True)
    (tmp_path / "parted" / "p=1" / "in.md").write_text("x")
    assert X.read_files(spark, str(tmp_path / "parted"), suffix=".md") is None
    assert [tuple(r) for r in read_markdown_folder(spark, str(tmp_path / "parted")).collect()] == [("in", "x")]
    nested = tmp_path / "nested"
    for path in ("p/models/a.sql", "p/models/d/_b.sql", "_h/models/c.sql", "_metadata/models/d.sql", ".g/e.sql", "f.sql"):
        (nested / path).parent.mkdir(parents=True, exist_ok=True)
        (nested / path).write_text(path)
    got = sorted(r.text for r in X.read_files(spark, str(nested), nested=True).collect())
    assert got == sorted(r.value for r in spark.read.option("recursiveFileLookup", "true").text(str(nested), wholetext=True).collect())
