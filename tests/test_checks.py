from pyspark.sql import functions as F

from conftest import SF01
from tabledocs.operators import checks as C


def t(spark, name):
    return spark.read.parquet(f"{SF01}/{name}.parquet")


def test_unique_known_surplus(spark):
    f = C.failing_unique(t(spark, "lineitem"), ["l_orderkey", "l_linenumber"])
    surplus = f.agg(F.sum(F.col("n_records") - 1)).first()[0]
    assert surplus == 14168
    d = C.failing_unique(t(spark, "documents"), "text").agg(F.sum(F.col("n_records") - 1)).first()[0]
    assert d == 73
    assert C.failing_unique(t(spark, "orders"), "o_orderkey").count() == 0


def test_nulls_pass_all_but_not_null(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (None, "y"), (None, "z")], "k int, v string")
    assert C.failing_unique(df, "k").first().n_records == 2
    assert C.failing_not_null(df, "v").count() == 1
    assert C.failing_accepted_values(df, "v", ["x", "y"]).collect()[0].v == "z"
    parent = spark.createDataFrame([(1,)], "k int")
    assert C.failing_relationships(df, "k", parent, "k").count() == 0


def test_accepted_values_known(spark):
    assert C.failing_accepted_values(t(spark, "orders"), "o_orderstatus", ["O", "F", "P"]).count() == 0
    assert C.failing_accepted_values(t(spark, "lineitem"), "l_returnflag", ["A", "N", "R"]).count() == 0
    assert C.failing_accepted_values(t(spark, "events"), "event_type",
                                     ["signup", "error", "click", "view", "purchase"]).count() == 0


def test_relationships_known(spark):
    assert C.failing_relationships(t(spark, "lineitem"), "l_orderkey", t(spark, "orders"), "o_orderkey").count() == 0
    assert C.failing_relationships(t(spark, "labels"), "doc_id", t(spark, "documents"), "doc_id").count() == 0
    part = t(spark, "orders").where("o_orderstatus = 'F'")
    assert C.failing_relationships(t(spark, "lineitem"), "l_orderkey", part, "o_orderkey").count() > 0


def test_run_tests_summary(spark):
    tables = {n: t(spark, n) for n in ["orders", "lineitem"]}
    tests = [C.DeclaredTest("orders", "o_orderkey", "unique"),
             C.DeclaredTest("orders", "o_orderstatus", "accepted_values", {"values": ["O", "F"]}),
             C.DeclaredTest("lineitem", "l_orderkey", "relationships", {"to": "orders", "field": "o_orderkey"})]
    rows = C.run_tests(tests, tables).orderBy("test_pos").collect()
    assert [r.status for r in rows] == ["pass", "fail", "pass"]
    assert rows[1].test_text == "accepted_values(values=[O, F])"


def test_no_tests_gives_empty_report(spark):
    out = C.run_tests([], {"orders": t(spark, "orders")})
    assert out.count() == 0 and "status" in out.columns


def test_empty_inputs(spark):
    from tabledocs.operators.protect import pii_scan
    empty = spark.createDataFrame([], "id long, text string")
    rows = pii_scan(empty, "e", ["text"]).collect()
    assert {(r.rule, r.rows_total, r.rows_matched, r.match_count) for r in rows} == \
        {(n, 0, 0, 0) for n in ("email", "ip", "phone_intl", "phone_na")}
    assert C.failing_unique(empty, "text").count() == 0
    assert C.failing_relationships(empty, "id", empty, "id").count() == 0


def test_accepted_booleans(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert C.failing_accepted_values(df, "b", [True, False]).collect() == []
    assert [r.b for r in C.failing_accepted_values(df, "b", ["true", "maybe"]).collect()] == [False]


def test_declared_text_of_nested_lists(spark):
    from tabledocs.functions.testtext import declared_texts
    kwargs = {"b": [1, ["x, y", [True, None]], {"k": ["v", 1]}], "a": None, "model": "m", "c": "say \"hi\"", "d": []}
    assert declared_texts(spark, [("t", kwargs), ("u", {"column_name": "x"}), ("v", None)]) == [
        't(b=[1, [x, y, [true, None]], {"k":["v",1]}], a=None, c=say "hi", d=[])', "u", "v"]


def wide(spark):
    return spark.sql("""SELECT id, `a.b`, m, parse_json(v) AS v, s, d, f, ts, dt FROM VALUES
        (1, 'x', map('k', 1, 'l', 2), '{"a":1}', named_struct('p', map('q', 1)), 1.10BD, 0.0D, timestamp'2024-01-01', date'2024-01-01'),
        (2, 'x', map('l', 2, 'k', 1), '{"a": 1}', named_struct('p', map('q', 1)), 1.1BD, -0.0D, timestamp'2024-01-01', date'2024-01-02'),
        (3, 'y', map('k', 3), '[1]', named_struct('p', map('q', 2)), 2.0BD, double('NaN'), null, date'2024-01-03'),
        (4, null, null, null, null, null, double('NaN'), timestamp'2024-01-02', null) AS t(id, `a.b`, m, v, s, d, f, ts, dt)""")


def test_keys_of_any_type(spark):
    """Maps in any order, variants, nested maps, dotted names, signed zeros."""
    df = wide(spark)
    tests = [C.DeclaredTest("t", c, "unique") for c in df.columns] + [C.DeclaredTest("t", ["a.b", "m"], "unique"), C.DeclaredTest("t", "a.b", "not_null"),
                                                                      C.DeclaredTest("t", "a.b", "accepted_values", {"values": ["y"]})]
    got = [r.failures for r in C.run_tests(tests, {"t": df}).orderBy("test_pos").collect()]
    assert got == [0, 2, 2, 2, 2, 2, 4, 2, 0, 2, 1, 2]
    for t, n in zip(tests[:10], got):
        assert (C.failing_unique(df, t.column).agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0]) == n, t
    assert C.failing_unique(df, "a.b").columns == ["a.b", "n_records"]
    assert C.failing_not_null(df, "a.b").count() == 1
    assert [tuple(r) for r in C.failing_relationships(df, "a.b", df.where("id = 3"), "a.b").collect()] == [("x", 2)]
    assert C.failing_relationships(df, "m", df.where("id = 2"), "m").count() == 1
    import pytest
    with pytest.raises(ValueError, match="plain values"):
        C.failing_accepted_values(df, "m", ["x"])


def test_relationships_across_types(spark):
    child = spark.sql("SELECT * FROM VALUES (1, '7', date'2024-01-01'), (2, 'x', null), (null, null, date'2024-01-02') AS t(i, s, d)")
    parent = spark.sql("SELECT * FROM VALUES (1L, 1.0D, '7', timestamp'2024-01-01 00:00:00'), (null, 2.0D, '8', null) AS t(i, f, s, ts)")
    pairs = [("i", "i"), ("i", "f"), ("s", "s"), ("d", "ts")]
    tests = [C.DeclaredTest("c", a, "relationships", {"to": "p", "field": b}) for a, b in pairs]
    got = [r.failures for r in C.run_tests(tests, {"c": child, "p": parent}).orderBy("test_pos").collect()]
    assert got == [1, 0, 1, 1]
    assert got == [C.failing_relationships(child, a, parent, b).agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0] for a, b in pairs]


def test_report_scans_each_table_once_and_plans_without_a_job(spark):
    tables = {n: t(spark, n) for n in ["orders", "lineitem", "documents"]}
    tests = [C.DeclaredTest("lineitem", "l_orderkey", "relationships", {"to": "orders", "field": "o_orderkey"}), C.DeclaredTest("lineitem", ["l_orderkey", "l_linenumber"], "unique"),
             C.DeclaredTest("lineitem", "l_partkey", "relationships", {"to": "lineitem", "field": "l_suppkey"}), C.DeclaredTest("lineitem", "l_tax", "not_null"),
             C.DeclaredTest("orders", "o_orderkey", "unique"), C.DeclaredTest("documents", "text", "unique")]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("report-plan", "planning only")
    out = C.run_tests(tests, tables)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not tracker.getJobIdsForGroup("report-plan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert plan.count("FileScan parquet") == 3
    by_one = {i: (C.failing_unique(tables[x.table], x.column) if x.test == "unique" else C.failing_not_null(tables[x.table], x.column).withColumn("n_records", F.lit(1)) if x.test == "not_null"
                  else C.failing_relationships(tables[x.table], x.column, tables[x.kwargs["to"]], x.kwargs["field"])).agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0]
              for i, x in enumerate(tests)}
    assert {r.test_pos: r.failures for r in out.collect()} == by_one
