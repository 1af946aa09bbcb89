"""What the manifest steps leave on disk, and what they work out once."""
import glob
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tabledocs.plans import registered_metadata as R
from tabledocs.session import materialize, shared_dir
from tabledocs.sources import manifest as M
from tabledocs.sources.manifest_split import read_entries


@pytest.fixture
def tables(spark, tmp_path):
    """Twenty parts in one file of one row group, two suppliers, a test a part and number."""
    i = F.col("id")
    spark.range(1, 21, numPartitions=1).select(i.alias("p_partkey"), F.lit("x").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), (i % 12).cast("int").alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(1, 3, numPartitions=1).select(i.alias("s_suppkey"), F.lit("s").alias("s_name"), F.lit(7).alias("s_nationkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(0, 120, numPartitions=1).select((i % 40).alias("l_orderkey"), (i % 20 + 1).alias("l_partkey"), (i % 2 + 1).alias("l_suppkey"), (i % 6 + 1).cast("int").alias("l_linenumber"),
                                                F.lit("O").alias("l_linestatus"), F.lit("A").alias("l_returnflag")).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_manifest_text_goes_once_it_is_parsed(spark, tables):
    folder = lambda sub: shared_dir(spark, f"tabledocs/{sub}").removeprefix("file://")
    before = set(glob.glob(folder("tables") + "/*"))
    nodes, _ = R._nodes(spark, tables)
    assert nodes.where("node.resource_type = 'test'").count() == 120 and nodes.where("node.resource_type = 'model'").count() == 20
    assert glob.glob(folder("manifests") + "/*/**/*.txt*", recursive=True) == []
    # nor is the text of entries kept beside the parsed nodes
    kept = [spark.read.parquet(p) for p in set(glob.glob(folder("tables") + "/*")) - before if os.path.basename(p).startswith("manifest-entries")]
    assert kept and all(df.where("section = 'nodes' and text is not null").count() == 0 for df in kept)


def test_odd_entries_are_parsed_as_objects_of_one_key(spark, tmp_path):
    """Keys with escapes, values that aren't objects or don't fit: as before."""
    odd = ['"a\\"b": {"name": "x"}', '"tab\\u0009": {"name": "y"}', '"null": null', '"number": 2', '"text": "t"', '"list": [{"name": "z"}]', '"empty": {}', '"": {"name": "e"}', '"no": {"name": tru}',
           '"fit": {"name": {"a": 1}, "depends_on": "x", "columns": 3}', '"extra": {"_corrupt_record": "c", "name": "n"}', '"kw" : {"test_metadata": {"name": "t", "kwargs": {"b": [1, "x"], "a": null}}}', '"plain": {"name": "p", "depends_on": {"nodes": ["m"]}}']
    (tmp_path / "m.json").write_text('{"metadata": {"project_name": "p"}, "nodes": {' + ", ".join(odd) + '}, "sources": {"s": {"name": "s"}, "n": null}}')
    got, sources = M.read_manifests(spark, str(tmp_path / "m.json"))
    entries = read_entries(spark, str(tmp_path / "m.json"), ("nodes",))
    one = F.map_entries(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), f"map<string, {M.NODE_DDL}>"))
    want = entries.select("pos", F.inline_outer(one).alias("node_id", "node")).where("node_id is not null")
    rows = lambda df: sorted((r["pos"], r["node_id"], r["node"]) for r in df.select("pos", "node_id", F.to_json("node").alias("node")).collect())
    assert rows(got) == rows(want) and {"a\"b", "tab\t", "null", "empty", "", "fit", "extra", "kw", "plain"} <= {r[1] for r in rows(got)}
    assert sorted((r["node_id"], r["node"] and r["node"]["name"], r["project_name"]) for r in sources.collect()) == [("n", None, "p"), ("s", "s", "p")]


def test_shuffle_files_of_a_large_table_go(spark):
    blocks = lambda: sum("shuffle_" in f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = blocks()
    df = materialize(spark.range(1000).repartition(5, "id"), "kept", large=True)
    for _ in range(50):
        if blocks() <= before:
            break
        time.sleep(0.2)
    assert blocks() <= before and df.count() == 1000


def test_columns_and_parents_are_worked_out_once(spark, tables, monkeypatch):
    """Both builds read them from a table, with no tests joined again."""
    plans = []

    def build(entities, columns, lineage, *args, **more):
        plans.extend(df._jdf.queryExecution().optimizedPlan().toString() for df in (entities, columns, lineage))
        return real(entities, columns, lineage, *args, **more)
    real = R.I.build
    monkeypatch.setattr(R.I, "build", build)
    got = {(r["slug"], r["change"]) for r in R.docs_incremental(spark, tables).collect()}
    assert len(plans) == 6 and not any("Join" in p or "Generate" in p for p in plans)
    assert got == {("prod.part_7", "changed"), ("prod.part_19", "changed"), ("prod.part_9", "removed"), ("b.part_11", "new")}


def test_compiled_files_are_written_by_many_tasks(spark, tables, monkeypatch):
    """However the table of their names is stored."""
    tasks = []

    def write(session, rows, folder):
        tasks.append(rows.rdd.getNumPartitions())
        return real(session, rows, folder)
    real = R.write_files
    monkeypatch.setattr(R, "write_files", write)
    docs = {r["slug"]: r["body"] for r in R.docs_full(spark, tables).collect()}
    assert tasks[0] > 1
    assert "compiled 3" in docs["prod.part_3"] and "select 5" in docs["prod.part_5"] and len(docs) == 22


def test_several_entries_on_a_line(spark, tmp_path):
    entries = [{f"n{i}": {"name": f"{i}}}{{"}} for i in range(100)]
    lines = ['{"metadata": {"project_name": "p"}, "nodes": {"first": {}'] + [" ".join("," + json.dumps(e)[1:-1] for e in entries[i:i + 7]) for i in range(0, 100, 7)] + ['}, "sources": {}}']
    (tmp_path / "a").mkdir()
    for n in range(0, len(lines), 4):
        (tmp_path / "a" / f"part-{n:05d}.txt").write_text("\n".join(lines[n:n + 4]))
    nodes, _ = M.read_manifests(spark, str(tmp_path / "a" / "*.txt"), in_parts=True)
    assert [(r["pos"], r["node_id"], r["node"]["name"]) for r in nodes.orderBy("pos").collect()] == [(0, "first", None)] + [(i + 1, f"n{i}", f"{i}}}{{") for i in range(100)]
