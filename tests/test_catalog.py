import json
import os

import pytest

from conftest import FIXTURES
from tabledocs.operators.catalog import build_catalog, dedupe_by_slug, ordered
from tabledocs.sources.manifest import manifests_from_text, parse_manifests, read_manifests

MANIFEST = os.path.join(FIXTURES, "manifest_small.json")


@pytest.fixture(scope="module")
def parsed(spark):
    return read_manifests(spark, MANIFEST)


def test_missing_manifest(spark):
    with pytest.raises(FileNotFoundError, match="nope/target/manifest.json"):
        read_manifests(spark, "/tmp/nope/target/manifest.json")


def test_entities_and_defaults(parsed):
    cat = build_catalog(*parsed)
    rows = [(r.kind, r.slug, r.compiled_sql) for r in ordered(cat.entities).collect()]
    assert rows == [("model", "prod.dim_gadget", "select 1 as gadget_id"),
                    ("model", "prod.fct_order", "select 2"),
                    ("model", "staging.stg_gadget", None),
                    ("source", "prod.dim_gadget", None),
                    ("source", "public.raw_event", None),
                    ("source", "raw.raw_gadget", None)]


def test_prefix_filters(parsed):
    cat = build_catalog(*parsed, include=["dim_", "fct_"])
    assert {(r.kind, r.table_name) for r in cat.entities.collect()} == \
        {("model", "dim_gadget"), ("model", "fct_order"), ("source", "dim_gadget")}
    cat = build_catalog(*parsed, include=["dim_", "fct_"], exclude=["dim_"])
    assert {r.table_name for r in cat.entities.collect()} == {"fct_order"}


def test_columns_and_tests(parsed):
    cat = build_catalog(*parsed)
    cols = {(r.node_id.split(".")[-1], r.name): r for r in cat.columns.collect()}
    assert cols[("dim_gadget", "gadget_id")].tests == ["not_null", "unique"]
    assert cols[("dim_gadget", "gadget_id")].description == "Primary key."
    assert cols[("fct_order", "gadget_id")].tests == ["relationships(to=ref('dim_gadget'), field=gadget_id)"]
    assert cols[("fct_order", "state")].tests == ["accepted_values(values=[shipped, completed, pending])"]
    assert cols[("fct_order", "order_id")].tests == ["unique", "accepted_values(values=[a, b], quote=false)"]
    assert cols[("raw_gadget", "gadget_id")].tests == ["not_null"]
    order = [r.name for r in cat.columns.where("node_id = 'model.shop.dim_gadget'").orderBy("pos").collect()]
    assert order == ["gadget_id", "shade", "buyer_email", "nickname"]


def test_model_level_and_orphan_tests(parsed):
    tests = build_catalog(*parsed).tests.collect()
    assert any(r.column_name is None and r.test_text == "row_count_check(min=1, strict=true)" for r in tests)
    assert not any(r.column_name == "x" for r in tests)


def test_lineage(parsed):
    lin = [(r.node_id, r.parent_name, r.parent_description) for r in
           build_catalog(*parsed).lineage.orderBy("node_id", "pos").collect()]
    assert lin == [("model.shop.dim_gadget", "source:raw_gadget", "Raw gadget stream."),
                   ("model.shop.fct_order", "dim_gadget", "One row per gadget.  Joined from fct_order.")]


def test_dedupe_source_wins(parsed):
    d = {r.slug: r.kind for r in dedupe_by_slug(build_catalog(*parsed).entities).collect()}
    assert d["prod.dim_gadget"] == "source" and len(d) == 5


def test_many_projects_at_once(spark):
    text = open(MANIFEST).read()
    other = json.loads(text)
    other["metadata"]["project_name"] = "other"
    raw = manifests_from_text(spark, [("p1", text), ("p2", json.dumps(other))])
    cat = build_catalog(*parse_manifests(raw))
    assert cat.entities.select("project").distinct().count() == 2
    assert cat.tests.where("project = 'p2'").count() == cat.tests.where("project = 'p1'").count() == 6


def test_compiled_sql_choice(spark, tmp_path):
    root = tmp_path / "compiled"
    (root / "shop" / "models" / "marts").mkdir(parents=True)
    (root / "shop" / "models" / "marts" / "dim_gadget.sql").write_text("  select compiled  \n")
    (root / "shop" / "models" / "marts" / "fct_order.sql").write_text("   \n")
    from tabledocs.sources.manifest import read_compiled_sql
    comp = read_compiled_sql(spark, str(root))
    cat = build_catalog(*read_manifests(spark, MANIFEST), compiled=comp)
    got = {r.table_name: r.compiled_sql for r in cat.entities.where("kind = 'model'").collect()}
    assert got == {"dim_gadget": "select compiled", "fct_order": None, "stg_gadget": None}


def test_compiled_roots(spark, tmp_path):
    """A parent folder named models; two checkouts of one project."""
    from tabledocs.sources.manifest import manifests_from_text, parse_manifests, read_compiled_sql
    import json
    comps = []
    for name in ("one", "two"):
        root = tmp_path / "models" / name / "compiled sql"
        (root / "shop" / "models" / "a+b").mkdir(parents=True)
        (root / "shop" / "models" / "a+b" / "my t.sql").write_text(f"select '{name}'")
        comps.append(read_compiled_sql(spark, str(root), manifest=name))
    text = json.dumps({"metadata": {"project_name": "shop"}, "sources": {}, "nodes": {
        "model.shop.t": {"resource_type": "model", "name": "t", "path": "a+b/my t.sql", "columns": {}}}})
    nodes = parse_manifests(manifests_from_text(spark, [("one", text), ("two", text)]))
    got = [(r.project, r.compiled_sql) for r in build_catalog(*nodes, compiled=comps[0].union(comps[1])).entities.orderBy("project").collect()]
    assert got == [("one", "select 'one'"), ("two", "select 'two'")]
    assert read_compiled_sql(spark, str(tmp_path / "none")).count() == 0
