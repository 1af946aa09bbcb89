import os

import pytest

from conftest import FIXTURES
from tabledocs.functions.fixed import MANUAL_MARKER
from tabledocs.operators.catalog import build_catalog
from tabledocs.plans.generate import generate
from tabledocs.sources.caches import load_sample_cache, save_sample_cache
from tabledocs.sources.manifest import read_manifests


@pytest.fixture(scope="module")
def cat(spark):
    return build_catalog(*read_manifests(spark, os.path.join(FIXTURES, "manifest_small.json")))


def _tables(spark):
    dim = spark.createDataFrame([("g1", "red", "a@b.com", "Al"), ("g2", "blue", None, "Bo")],
                                "gadget_id string, shade string, buyer_email string, nickname string")
    fct = spark.createDataFrame([(1, "g1", "call 555-123-4567")], "order_id long, gadget_id string, state string")
    return {"prod.dim_gadget": dim, "prod.fct_order": fct}


def test_generate_fetch_then_reuse(spark, cat, tmp_path):
    root = str(tmp_path / "samples")
    g = generate(spark, cat, _tables(spark), cache=load_sample_cache(spark, root))
    acts = {r.slug: r.action for r in g.actions.collect()}
    assert acts["prod.fct_order"] == "use_new" and acts["raw.raw_gadget"] == "none"
    body = {r.slug: r.body for r in g.docs.collect()}["prod.fct_order"]
    assert "## Sample rows (1 rows, one line per column)\n\n- `order_id`: 1\n- `gadget_id`: g1\n" \
           "- `state`: call <phone>\n" in body
    assert body.endswith(MANUAL_MARKER + "\n")
    dim = {r.slug: r.body for r in g.docs.collect()}["prod.dim_gadget"]
    # The source wins the slug and documents no columns; sample masking still
    # covers every PII-named column of the table (schema superset).
    assert "- `buyer_email`: <pii> | <pii>" in dim
    save_sample_cache(spark, g.cache, root)

    # Second run without a warehouse: valid cache entries are reused as they are.
    g2 = generate(spark, cat, None, cache=load_sample_cache(spark, root))
    acts2 = {r.slug: r.action for r in g2.actions.collect()}
    assert acts2["prod.fct_order"] == "reuse"
    body2 = {r.slug: r.body for r in g2.docs.collect()}["prod.fct_order"]
    assert body2 == body

    # Asking for a refresh without a warehouse reuses with a warning.
    g3 = generate(spark, cat, None, cache=load_sample_cache(spark, root), refresh=["prod.fct_order"])
    assert {r.slug: r.action for r in g3.actions.collect()}["prod.fct_order"] == "reuse_warn"


def test_generate_no_samples(spark, cat):
    g = generate(spark, cat, _tables(spark), sample_size=0)
    assert {r.action for r in g.actions.collect()} == {"none"}
    assert all("## Sample rows" not in r.body for r in g.docs.collect())
    assert g.index.count() == 1


def test_generate_inlines_catalog_section(spark, cat):
    from tabledocs.operators import entries as N
    from tabledocs.sources.catalogs import CatalogDecl, catalog_entries, catalogs_from_decls
    ev = "gadget-made:\n  description: A gadget is made.\n  attributes:\n    shade: Shade chosen.\n"
    e = catalog_entries(catalogs_from_decls(spark, [CatalogDecl("events", ev, "public.raw_event")], inline=True))
    sections = N.section_text(N.section_lines(e, {"events": N.events_kind()}))
    g = generate(spark, cat, None, sections=sections)
    body = {r.slug: r.body for r in g.docs.collect()}["public.raw_event"]
    assert body.startswith("# `public.raw_event` (source — events catalog)\n\nEvent stream.\n\n## Columns\n")
    assert "### data\n- Type: `super`\n\nJSON.\n\n\n## Events\n\n" in body
    assert "where event = 'gadget-made'\nlimit 5\n```\n\n" + MANUAL_MARKER in body


def test_search_and_list_generated_docs(spark, cat):
    from tabledocs.operators import search as Q
    g = generate(spark, cat, _tables(spark))
    corpus = Q.as_corpus(g.docs.unionByName(g.index), "slug", "body")
    listed = {r.name: r.description for r in Q.list_documents(corpus).collect()}
    assert "_index" not in listed
    assert listed["prod.fct_order"] == "Orders."
    hits = Q.search(corpus, "gadget_id").collect()
    assert [h.name for h in hits] == ["prod.dim_gadget", "prod.fct_order", "raw.raw_gadget"]
    fo = [h for h in hits if h.name == "prod.fct_order"][0]
    assert "relationships(to=ref('dim_gadget'), field=gadget_id)" in " ".join(fo.snippets)
    assert Q.read_document(corpus, "prod.fct_order").first().text.startswith("# `prod.fct_order` (model)")


def _two_projects(spark):
    """Two projects with a relation of one name; the second one flags a column."""
    import json

    from tabledocs.sources.manifest import manifests_from_text, parse_manifests
    text = lambda d, meta: json.dumps({"metadata": {"project_name": d}, "sources": {}, "nodes": {f"model.{d}.t": {
        "resource_type": "model", "name": "t", "schema": "prod", "description": f"Table of {d}.",
        "columns": {"k": {"description": "Key."}, "v": {"description": "Value.", "meta": meta}}}}})
    return build_catalog(*parse_manifests(manifests_from_text(spark, [("a", text("a", {})), ("b", text("b", {"pii": True}))])))


def test_projects_that_share_a_slug(spark, tmp_path):
    root = str(tmp_path / "samples")
    cat = _two_projects(spark)
    one = spark.createDataFrame([(1, "red"), (2, "blue")], "k int, v string")
    other = spark.createDataFrame([(7, "oak")], "k int, v string")
    notes = spark.createDataFrame([("a", "prod.t", f"x\n{MANUAL_MARKER}\nof a\n")], "project string, slug string, body string")
    bodies = lambda g: {(r.project, r.slug): r.body for r in g.docs.collect()}
    g = generate(spark, cat, {("a", "prod.t"): one, ("b", "prod.t"): other}, existing=notes, cache=load_sample_cache(spark, root))
    first = bodies(g)
    assert "## Sample rows (2 rows, one line per column)\n\n- `k`: 1 | 2\n- `v`: red | blue\n" in first["a", "prod.t"]
    assert "## Sample rows (1 rows, one line per column)\n\n- `k`: 7\n- `v`: <pii>\n" in first["b", "prod.t"]
    assert first["a", "prod.t"].endswith("of a\n") and first["b", "prod.t"].endswith(MANUAL_MARKER + "\n")
    save_sample_cache(spark, g.cache, root)
    again = generate(spark, cat, None, existing=notes, cache=load_sample_cache(spark, root))
    assert bodies(again) == first
    # a slug alone is that relation in both projects, and a pair can be refreshed alone
    both = generate(spark, cat, {"prod.t": one}, cache=load_sample_cache(spark, root), refresh=[("b", "prod.t")])
    assert {r.project: r.action for r in both.actions.collect()} == {"a": "reuse", "b": "use_new"}
    assert "- `k`: 1 | 2" in bodies(both)["b", "prod.t"]
    with pytest.raises(ValueError, match="prod.t"):
        from tabledocs.operators.docs import export_markdown
        export_markdown(g.docs, str(tmp_path / "out"))


def test_a_table_that_fails_keeps_the_others(spark, cat):
    tables = _tables(spark)
    bad = spark.createDataFrame([("x",)], "v string").selectExpr("assert_true(v = 'y') as v")
    for group in (bad, spark.range(1).selectExpr("cast('x' as int) as v")):
        g = generate(spark, cat, tables | {"raw.raw_gadget": group})
        acts = {r.slug: r.action for r in g.actions.collect()}
        assert acts["prod.fct_order"] == "use_new" and acts["prod.dim_gadget"] == "use_new"
        assert acts["raw.raw_gadget"] == "none"
        body = {r.slug: r.body for r in g.docs.collect()}
        assert "- `order_id`: 1\n" in body["prod.fct_order"] and "## Sample rows" not in body["raw.raw_gadget"]
