"""Manifests read by blocks, against a plain JSON reader."""
import json
import random

import pytest

from tabledocs.session import file_uri
from tabledocs.sources import manifest_split as M
from tabledocs.sources.manifest import parse_manifests, read_manifest_text, read_manifests

SIGNS = ['"', "\\", "{", "}", "[", "]", ",", ":", "é", "日", "\n", "a", " ", "\\\"", "}}", "{\"nodes\": {"]


def value(r, depth=0):
    kind = r.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return r.choice([1, -2.5, True, None, "", []])
    if kind < 4:
        return "".join(r.choice(SIGNS) for _ in range(r.randrange(12)))
    if kind == 4:
        return [value(r, depth + 1) for _ in range(r.randrange(4))]
    return {"".join(r.choice(SIGNS) for _ in range(r.randrange(1, 5))): value(r, depth + 1) for _ in range(r.randrange(4))}


def manifest(seed):
    r = random.Random(seed)
    section = lambda k: {f"{k}.{i}{r.choice(SIGNS)}": value(r) for i in range(r.randrange(60))}
    out = {"metadata": {"project_name": f"p{seed}", "extra": value(r)}, "macros": section("m"), "nodes": section("n"), "list": [value(r)], "sources": section("s"), "docs": value(r), "empty": {}}
    return json.dumps(out, indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5)


@pytest.mark.parametrize("size", ["64", "700", "1m"])
def test_entries_of_any_split(spark, tmp_path, size):
    files = {}
    for i in range(6):
        path = tmp_path / f"manifest {i}.json"
        path.write_text(manifest(i) + "\n" * (i % 2), encoding="utf-8")
        files[file_uri(spark, str(path))] = json.loads(path.read_text(encoding="utf-8"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = M.read_entries(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {(p, s, i, json.dumps({k: v}, sort_keys=True)) for p, m in files.items() for s in M.SECTIONS for i, (k, v) in enumerate(m[s].items())}
    assert {(r["project"], r["section"], r["pos"], json.dumps(json.loads("{" + r["text"] + "}"), sort_keys=True)) for r in got} == want
    assert len(got) == len(want)


def test_one_file_is_shared_out(spark, tmp_path):
    """A file of many blocks: equal nodes, read by many tasks."""
    nodes = {f"model.p.m{i}": {"resource_type": "model", "name": f"m{i}", "description": "x}{\"" * (i % 50), "columns": {"k": {"meta": {"pii": True}}}} for i in range(3000)}
    path = str(tmp_path / "manifest.json")
    with open(path, "w") as f:
        json.dump({"metadata": {"project_name": "p"}, "nodes": nodes, "sources": {}}, f)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        raw = spark.read.option("lineSep", "}").text(path)
        assert raw.rdd.getNumPartitions() > 20
        split, _ = read_manifests(spark, path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole, _ = parse_manifests(read_manifest_text(spark, path))
    flat = ["project", "project_name", "pos", "node_id", "node.name", "node.description", "node.columns.k.meta"]
    assert sorted(map(tuple, split.select(*flat).collect())) == sorted(map(tuple, whole.select(*flat).collect()))


def test_no_sections(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.json").write_text('{"nodes": [], "sources": {}, "metadata": null}')
    nodes, sources = read_manifests(spark, str(tmp_path))
    assert nodes.count() == sources.count() == 0
