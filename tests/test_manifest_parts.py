"""Manifests written in parts, and steps that many tasks share."""
import json

import pytest
from pyspark.sql import functions as F

from tabledocs.operators.catalog import test_owners as owners
from tabledocs.plans import registered_metadata as R
from tabledocs.session import file_uri
from tabledocs.sources.manifest import manifests_from_text, parse_manifests, read_manifests
from tabledocs.sources.manifest_split import read_entries


def _parts(folder, project, seed):
    nodes = {f"test.t.{i}{'{}' * (i % 3)}": {"resource_type": "test", "name": 'a "quoted\\" } name' * (i % 2), "column_name": f"c{i}", "attached_node": f"model.p.{seed}"} for i in range(300)}
    lines = ['{"metadata": {"project_name": "%s"}, "nodes": {"seed.first": {"resource_type": "seed"}' % project]
    lines += ["," + json.dumps({k: v})[1:-1] for k, v in nodes.items()] + ['}, "sources": {', '"source.a": {"name": "a"}', ',"source.b": {"name": "b"}', "}}"]
    folder.mkdir()
    for n, i in enumerate(range(0, len(lines), 40)):
        (folder / f"part-{n:05d}.txt").write_text("\n".join(lines[i:i + 40]) + "\n")
    return "\n".join(lines)


@pytest.mark.parametrize("size", ["500", "1m"])
def test_parts_are_one_manifest(spark, tmp_path, size):
    whole = [(file_uri(spark, str(tmp_path)) + f"/{p}", _parts(tmp_path / p, p, i)) for i, p in enumerate(("a", "b"))]
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = [df.select("project", "project_name", "pos", "node_id", "node.name").collect() for df in read_manifests(spark, str(tmp_path / "*" / "*.txt"), in_parts=True)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [df.select("project", "project_name", "pos", "node_id", "node.name").collect() for df in parse_manifests(manifests_from_text(spark, whole))]
    assert [len(x) for x in got] == [602, 4]
    assert [sorted(map(tuple, x)) for x in got] == [sorted(map(tuple, x)) for x in want]


def test_backslashes_and_plain_values(spark, tmp_path):
    m = {"metadata": {"project_name": "p"}, "nodes": {f"n{i}": "\\" * i + '"}{' for i in range(9)} | {"x": [1, {"a\\": "\\\""}], "y": 2}, "sources": {}}
    (tmp_path / "m.json").write_text(json.dumps(m))
    got = read_entries(spark, str(tmp_path), ("nodes",)).orderBy("pos").collect()
    assert [json.loads("{" + r["text"] + "}") for r in got] == [{k: v} for k, v in m["nodes"].items()]


def test_a_project_is_written_by_many_tasks(spark, tmp_path):
    """No task holds a whole project, and its lines keep their order over the parts."""
    cols = lambda n, *names: [(F.col("id") * 0 + n if isinstance(n, int) else n).alias(x) for x in names]
    spark.range(1, 21).select(F.col("id").alias("p_partkey"), *cols(F.lit("x"), "p_name", "p_brand", "p_type"), F.col("id").cast("int").alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(1, 4).select(F.col("id").alias("s_suppkey"), F.lit("s").alias("s_name"), F.lit(7).alias("s_nationkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(0, 20000).select(F.col("id").alias("l_orderkey"), F.lit(5).cast("bigint").alias("l_partkey"), F.lit(1).cast("bigint").alias("l_suppkey"), F.lit(6).alias("l_linenumber"),
                                 *cols(F.lit("O"), "l_linestatus", "l_returnflag")).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = R._manifest_lines(spark, str(tmp_path)).where("project = '0'").withColumn("task", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id()).orderBy("n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["task"] for r in lines}) > 2
    m = json.loads("".join(r["value"] for r in lines))
    assert [k for k in m["nodes"] if k.startswith("test")] == [f"test.t.{i}.6" for i in range(20000)]


def test_tests_without_a_lookup_are_spread(spark):
    """Tests that name no source or model don't all meet in one task."""
    nodes = {f"test.{i}": {"resource_type": "test", "name": "t", "column_name": "c", "attached_node": "model.m"} for i in range(400)}
    found = {"test.x": {"resource_type": "test", "name": "t", "column_name": "c", "test_metadata": {"kwargs": {"model": "ref('m')"}}}, "model.m": {"resource_type": "model", "name": "m"}}
    n, s = parse_manifests(manifests_from_text(spark, [("p", json.dumps({"nodes": nodes | found, "sources": {}}))]))
    for k, v in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.shuffle.partitions", "8")):
        spark.conf.set(k, v)
    try:
        rows = owners(n, s).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r["node_id"], r["column_name"]) for r in rows} == {("model.m", "c")} and len(rows) == 401
    assert len({r["task"] for r in rows}) > 4
