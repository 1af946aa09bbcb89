import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import FIXTURES, one
from tabledocs.functions.fixed import MANUAL_MARKER
from tabledocs.functions.rules import DEFAULT_RULES, rules_hash
from tabledocs.operators import docs as D
from tabledocs.operators import samples as SM
from tabledocs.operators.catalog import build_catalog, dedupe_by_slug
from tabledocs.sources.manifest import read_manifests


@pytest.fixture(scope="module")
def cat(spark):
    return build_catalog(*read_manifests(spark, os.path.join(FIXTURES, "manifest_small.json")))


def test_transposed_sample_masks_and_scrubs(spark):
    rows = spark.createDataFrame([(1, "red", "a@b.com", "see emp-1 | x\ny"), (2, "blue", None, None)],
                                 "widget_id int, color string, owner_email string, notes string")
    lines = SM.transposed_lines(SM.sample_long(rows, "prod.w", order_by=["widget_id"]))
    got = {r.column_name: r.line for r in lines.collect()}
    assert got == {"widget_id": "- `widget_id`: 1 | 2", "color": "- `color`: red | blue",
                   "owner_email": "- `owner_email`: <pii> | <pii>",
                   "notes": "- `notes`: see emp-1 \\| x y | NULL"}


def test_cell_cut_after_scrub(spark):
    v = "x" * 75 + " me@example.com " + "y" * 20
    got = one(spark, lambda c: SM.cell_text(F.col(c)), v)
    assert got == (("x" * 75 + " <email> " + "y" * 20)[:80] + "…")


def test_head_zero_is_no_sample(spark):
    assert SM.head(spark.range(3), 0) is None


@pytest.mark.parametrize("names", [["b", "a", "a"], ["naïve", "x\"y", "tab\tz", "😀"], []])
def test_names_hash_equals_python(spark, names):
    df = spark.createDataFrame([(names,)], "n array<string>")
    got = df.select(SM.names_hash(F.col("n")).alias("h")).first().h
    want = "sha256:" + hashlib.sha256(json.dumps(sorted(set(names))).encode()).hexdigest()
    assert got == want


def test_refresh_plan_and_cache(spark, cat):
    ents = dedupe_by_slug(cat.entities)
    fp = SM.entity_fingerprints(cat.columns)
    obf = rules_hash(DEFAULT_RULES)
    good = fp.join(ents, ["project", "node_id"]).where("slug = 'prod.fct_order'").first()
    project = ents.first().project
    cache = spark.createDataFrame(
        [(project, "prod.fct_order", 1, "prod", "fct_order", "t", good.column_names_hash, obf,
          [(p.name, None, p.is_pii) for p in good.pii_map], [{"a": "1"}], []),
         (project, "raw.raw_gadget", 1, "raw", "raw_gadget", "t", "sha256:stale", obf, [], [{"a": "1"}], [])],
        SM.CACHE_SCHEMA)
    v = SM.cache_validity(ents, fp, cache, obf)
    valid = {r.slug: r.cache_valid for r in v.collect()}
    assert valid["prod.fct_order"] and not valid["raw.raw_gadget"]
    act = {r.slug: r.action for r in SM.refresh_plan(v).collect()}
    assert act["prod.fct_order"] == "reuse" and act["raw.raw_gadget"] == "fetch"
    act = {r.slug: r.action for r in SM.refresh_plan(v, refresh=["prod.fct_order"], can_fetch=False).collect()}
    assert act["prod.fct_order"] == "reuse_warn" and act["raw.raw_gadget"] == "none"
    assert {r.action for r in SM.refresh_plan(v, sample_size=0).collect()} == {"none"}
    plan = SM.refresh_plan(v, refresh_all=True)
    after = {r.slug: r.action for r in SM.after_fetch(plan, spark.createDataFrame([(project, "raw.raw_gadget")], "project string, slug string")).collect()}
    assert after["raw.raw_gadget"] == "use_new" and after["prod.fct_order"] == "reuse_warn"
    assert after["public.raw_event"] == "none"
    # A changed ruleset invalidates every cached sample.
    assert not any(r.cache_valid for r in SM.cache_validity(ents, fp, cache, "sha256:other").collect())


def test_document_shape(spark, cat):
    ents = dedupe_by_slug(cat.entities)
    docs, index = D.build_docs(ents, cat.columns, cat.lineage)
    body = {r.slug: r.body for r in docs.collect()}
    fo = body["prod.fct_order"]
    assert fo.startswith("# `prod.fct_order` (model)\n\nOrders.\n\n## Columns\n\n### order_id\n- Type: `bigint`\n\nKey.\n\n")
    assert "## Parents\n\n- `dim_gadget` — One row per gadget.\n\n## Compiled SQL\n\n```sql\nselect 2\n```\n\n" + MANUAL_MARKER + "\n" in fo
    assert body["prod.dim_gadget"].startswith("# `prod.dim_gadget` (source)\n\nSame relation as the model.\n\n"
                                              "## Columns\n\n_(No columns documented.)_\n")
    idx = index.first().body
    assert idx.startswith("# Schema index\n\nOne file per table/source.")
    assert idx.index("## Models") < idx.index("## Sources")
    assert "- [`prod.fct_order`](./prod.fct_order.md) — Orders." in idx
    assert idx.endswith("Raw gadget stream.\n")


def test_notes_preserved(spark, cat):
    ents = dedupe_by_slug(cat.entities)
    existing = spark.createDataFrame([("prod.fct_order", f"old top\n{MANUAL_MARKER}\nkeep me\n\n\n")],
                                     "slug string, body string")
    docs, _ = D.build_docs(ents, cat.columns, cat.lineage, existing=existing)
    b = {r.slug: r.body for r in docs.collect()}
    assert b["prod.fct_order"].endswith(f"```\n\n{MANUAL_MARKER}\nkeep me\n")
    assert "old top" not in b["prod.fct_order"]
    assert b["raw.raw_gadget"].endswith(f"\n\n{MANUAL_MARKER}\n")


def test_export_markdown(spark, tmp_path):
    docs = spark.createDataFrame([("a.b", "x\n")], "slug string, body string")
    D.export_markdown(docs, str(tmp_path / "out"))
    assert (tmp_path / "out" / "a.b.md").read_text() == "x\n"


def test_export_text(spark, tmp_path):
    docs = spark.createDataFrame([("a.b", "x\ny\n"), ("c.d", "z\n")], "slug string, body string")
    D.export_text(docs, str(tmp_path / "txt"))
    import glob
    got = "".join(open(f).read() for f in glob.glob(str(tmp_path / "txt" / "slug=a.b" / "part-*")))
    assert got == "x\ny\n"


def test_samples_in_groups(spark):
    tables = {f"s.t{i}": (spark.range(i, i + 10).withColumnRenamed("id", "k"), ["k"]) for i in range(5)}
    one = SM.samples_long(tables, n=2)
    grouped = SM.samples_long(tables, n=2, group=2)
    key = lambda r: (r.slug, r.rn, r.col_pos, r.value)
    assert sorted(map(key, one.collect())) == sorted(map(key, grouped.collect()))
    assert {(r.slug, r.value) for r in grouped.where("rn = 1").collect()} == {(f"s.t{i}", str(i)) for i in range(5)}
