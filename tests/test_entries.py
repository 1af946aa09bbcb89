import pytest

from tabledocs.operators import entries as N
from tabledocs.sources.catalogs import CatalogDecl, catalog_entries, catalogs_from_decls

EVENTS = """widget-created:
  description: A user creates a new widget.
  attributes:
    color: Chosen widget colour.
    source: Where the create dialog was opened from.

widget-deleted:
  description: A user deletes a widget.
  attributes:
    reason: Why the user said they deleted it.
"""
PLANS = """free:
  description: Free tier.
  price: $0
  seats_included: 1
pro:
  description: Per-seat tier for working teams.
  price: $12 / seat / month
  seats_included: 5
  features:
    - Unlimited boards
    - SSO
  limits:
    export_quota_gb: 50
    boards_per_workspace: unlimited
  pricing_page: https://example.com/pricing/pro
  deprecated: false
legacy:
  description: Old plan.
  price: $5
  deprecated: true
"""
FLAGS = """beta-dashboard:
  description: New dashboard.
  attributes:
    owner: growth team
    rollout: 10%
"""
INCIDENTS = """db-outage:
  description: Primary database unavailable.
  severity: high
  runbook: https://runbooks/db
"""


@pytest.fixture(scope="module")
def sections(spark):
    decls = [CatalogDecl("plans", PLANS, "public.plans"), CatalogDecl("events", EVENTS, "public.events"),
             CatalogDecl("feature_flags", FLAGS, "public.feature_flags", "Feature flags"),
             CatalogDecl("incidents", INCIDENTS, "public.incidents"),
             CatalogDecl("incidents", "x:\n  description: later wins\n", "public.incidents"),
             CatalogDecl("orphan", "y:\n  description: no table\n", "")]
    e = catalog_entries(catalogs_from_decls(spark, decls, inline=True))
    kinds = {"events": N.events_kind(), "plans": N.plans_kind()}
    return {r.table_slug: r.section for r in N.section_text(N.section_lines(e, kinds)).collect()}


def test_zero_code_catalog(sections):
    assert sections["public.feature_flags"] == (
        "## Feature flags\n\n### `beta-dashboard`\n\nNew dashboard.\n\n**Attributes:**\n"
        "- `owner` — growth team\n- `rollout` — 10%")


def test_last_catalog_per_table_and_empty_table(sections):
    assert sections["public.incidents"] == "## Incidents\n\n### `x`\n\nlater wins"
    assert "" not in sections


def test_events_kind(sections):
    s = sections["public.events"]
    assert s.startswith("## Events\n\nThe `event` column below is a filter on the event name.")
    assert ('select\n    id,\n    created,\n    event,\n    data."color"::text as "color",\n'
            '    data."source"::text as "source"\nfrom public.events\nwhere event = \'widget-created\'\nlimit 5') in s
    assert s.index("widget-created") < s.index("widget-deleted")


def test_plans_kind(sections):
    s = sections["public.plans"]
    assert "| `free` | $0 | 1 |\n| `legacy` | $5 | — |\n| `pro` | $12 / seat / month | 5 |" in s
    pro = s[s.index("### `pro`"):]
    # declared field order, dict fields sorted by key, lists in order, booleans yes/no
    assert pro.index("**Price:**") < pro.index("**Seats included:** 5") < pro.index("**Features:**") \
        < pro.index("**Limits:**") < pro.index("**Pricing page:**") < pro.index("**Deprecated:** no")
    assert "**Limits:**\n- `boards_per_workspace` — unlimited\n- `export_quota_gb` — 50" in pro
    assert "**Features:**\n- Unlimited boards\n- SSO" in pro
    assert "[See `pro` pricing](https://example.com/pricing/pro)" in pro
    assert "> **Deprecated** — new signups are not allowed." in s[s.index("### `legacy`"):s.index("### `pro`")]


def test_missing_catalog_file_skipped(spark):
    df = catalogs_from_decls(spark, [CatalogDecl("events", "/tmp/does-not-exist.yml", "t")])
    assert df.count() == 0


def test_catalog_file_source(spark, tmp_path):
    p = tmp_path / "events.yml"
    p.write_text(EVENTS)
    e = catalog_entries(catalogs_from_decls(spark, [CatalogDecl("events", str(p), "public.events")]))
    assert [r.name for r in e.orderBy("file_pos").collect()] == ["widget-created", "widget-deleted"]


def test_event_attributes_job(spark):
    events = spark.createDataFrame(
        [(1, "widget-created", '{"color": "red", "source": "menu"}'), (2, "widget-deleted", '{"reason": "x"}'),
         (3, "other", "{}")], "id long, event string, data string")
    e = catalog_entries(catalogs_from_decls(spark, [CatalogDecl("events", EVENTS, "t")], inline=True))
    rows = {(r.id, r.attribute, r.value) for r in N.event_attributes(events, e, "event", "data", ["id", "event"]).collect()}
    assert rows == {(1, "color", "red"), (1, "source", "menu"), (2, "reason", "x")}


def test_event_extract_filter_pushed(spark, tmp_path):
    p = str(tmp_path / "ev")
    spark.createDataFrame([(i, "click" if i % 2 else "view", f'{{"k": {i}, "a.b": "x"}}') for i in range(10)],
                          "id long, event string, data string").write.parquet(p)
    ev = spark.read.parquet(p)
    df = N.event_extract(ev, "click", "event", "data", ["id", "event"], ["k", "a.b"], head_limit=3)
    assert [(r.id, r.k, r["a.b"]) for r in df.collect()] == [(1, "1", "x"), (3, "3", "x"), (5, "5", "x")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event), EqualTo(event,click)]" in plan


def test_markdown_folder(spark, tmp_path):
    from tabledocs.sources.corpus import read_markdown_folder
    (tmp_path / "_index.md").write_text("# idx")
    (tmp_path / "a.b.md").write_text("# a\nhello")
    (tmp_path / "notes.txt").write_text("skip")
    assert [(r.name, r.text) for r in read_markdown_folder(spark, str(tmp_path)).collect()] == [("a.b", "# a\nhello")]


def test_catalog_json_file(spark, tmp_path):
    import json
    p = tmp_path / "flags.json"
    p.write_text(json.dumps({"b": {"description": "second", "z": 1, "a": 2}, "a": {"description": "first"}}))
    e = catalog_entries(catalogs_from_decls(spark, [CatalogDecl("flags", str(p), "t")]))
    from pyspark.sql import functions as F
    rows = e.orderBy("file_pos").select("name", F.map_keys("spec").alias("keys")).collect()
    assert [r.name for r in rows] == ["b", "a"]
    assert rows[0]["keys"] == ["description", "z", "a"]  # declared order kept


def test_last_catalog_wins_when_empty(spark):
    decls = [CatalogDecl("events", EVENTS, "t"), CatalogDecl("plans", "{}", "t"), CatalogDecl("events", EVENTS, "u"), CatalogDecl("plans", "", "v")]
    e = catalog_entries(catalogs_from_decls(spark, decls, inline=True))
    got = {r.table_slug: (r.kind, r.section) for r in N.section_text(N.section_lines(e, {"events": N.events_kind(), "plans": N.plans_kind()})).collect()}
    assert got["t"] == ("plans", None) and got["v"] == ("plans", None)
    assert got["u"][0] == "events" and got["u"][1].startswith("## Events")
    assert N.attribute_names(e).where("name is null").count() == 0


def test_options_of_a_declaration(spark):
    own = {"column": "kind", "data_column": "props", "core_columns": ["ts", "kind"], "head_limit": 9}
    decls = [CatalogDecl("events", EVENTS, "t", options=own), CatalogDecl("events", EVENTS, "u")]
    e = catalog_entries(catalogs_from_decls(spark, decls, inline=True))
    got = {r.table_slug: r.section for r in N.section_text(N.section_lines(e, {"events": N.events_kind()})).collect()}
    assert "The `kind` column" in got["t"] and "The `event` column" in got["u"]
    assert 'select\n    ts,\n    kind,\n    props."color"::text as "color"' in got["t"] and "where kind = 'widget-created'\nlimit 9" in got["t"]
    assert "limit 5" in got["u"] and "props" not in got["u"]


def test_paths_with_blanks(spark, tmp_path):
    p = tmp_path / "my events+50%.yml"
    p.write_text(EVENTS)
    e = catalog_entries(catalogs_from_decls(spark, [CatalogDecl("events", str(p), "t"), CatalogDecl("events", f"file://{tmp_path}/none.yml", "t")]))
    assert [r.name for r in e.orderBy("file_pos").collect()] == ["widget-created", "widget-deleted"]


def test_attribute_names_with_quotes(spark):
    events = spark.createDataFrame([(1, "e", '{"it\'s": 1, "a.b": {"c": 2}}')], "id long, event string, data string")
    got = N.event_extract(events, "e", "event", "data", ["id"], ["it's", "a.b", "none"]).first()
    assert (got["it's"], got["a.b"], got["none"]) == ("1", '{"c":2}', None)
