import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import one
from tabledocs.functions.fixed import MUTATION_KEYWORDS
from tabledocs.functions.guard import guard_reason, sql_fingerprint, sql_log_hash, strip_comments, token_hash
from tabledocs.plans.sql import ReadOnlyViolation, assert_read_only, run_sql, execute, markdown_table_lines

ACCEPTED = [
    "SELECT o_orderkey FROM orders WHERE o_totalprice > 100",
    "\n\tWith big AS (SELECT * FROM orders) SELECT count(*) AS n FROM big ;\n",
    "SELECT /* why: audit */ max(created_on) FROM log -- newest first",
    "select droplet, deleted, settings, beginning FROM spring",
]

REJECTED = [("\t\n", "empty SQL"), ("/* nothing */ -- at all", "no SQL keyword"), ("EXPLAIN SELECT 1", "EXPLAIN"),
            ("SELECT 2; SELECT 3;", "multiple statements"), ("SELECT 'please update' AS hint", "UPDATE"),
            ("WITH gone AS (SELECT 7 AS k) DELETE FROM stock WHERE k IN (SELECT k FROM gone)", "DELETE")]
# a statement of each kind of change, after a comment and in mixed case
REJECTED += [(f"-- job 9\n{verb.title()} something", verb) for verb in MUTATION_KEYWORDS]


@pytest.mark.parametrize("sql", ACCEPTED)
def test_accepts_selects(spark, sql):
    assert one(spark, guard_reason, sql) is None


@pytest.mark.parametrize("sql,reason", REJECTED)
def test_rejects(spark, sql, reason):
    r = one(spark, guard_reason, sql)
    assert r is not None and reason in r


def test_guard_on_null(spark):
    assert one(spark, guard_reason, None) == "empty SQL"


def test_lexical_quirks_kept(spark):
    # First identifier need not be at the start; INTO is not a listed keyword.
    assert one(spark, guard_reason, "(SELECT 1)") is None
    assert one(spark, guard_reason, "SELECT a INTO t2 FROM t") is None
    # A comment marker inside a literal hides the second statement lexically.
    assert one(spark, guard_reason, "SELECT '--'; DROP TABLE x") is None


def test_plan_check_closes_lexical_holes(spark):
    for sql in ["SELECT '--'; DROP TABLE x", "SELECT '/*'; DROP TABLE x /* */",
                "SELECT * FROM parquet.`/root/testdata/sf0.01/orders.parquet`",
                "SELECT java_method('java.lang.System', 'exit', 0)",
                "SELECT reflect('java.lang.Thread', 'sleep', 1)",
                "SELECT TRANSFORM(a) USING 'cat' FROM (SELECT 1 a)",
                "SELECT a INTO t2 FROM t",
                "WITH x AS (SELECT TRANSFORM(a) USING 'cat' FROM (SELECT 1 a)) SELECT * FROM x",
                "WITH x AS (SELECT * FROM parquet.`/root/testdata/sf0.01/orders.parquet`) SELECT * FROM x",
                "WITH x AS (WITH y AS (SELECT * FROM csv.`relative`) SELECT * FROM y) SELECT * FROM x",
                "SELECT java_method/**/('java.lang.System', 'exit', 0)", "SELECT `java_method`('java.lang.System', 'exit', 0)",
                "SELECT * FROM IDENTIFIER('parquet.`/root/testdata/sf0.01/orders.parquet`')",
                "SELECT 1 WHERE 1 IN (SELECT `reflect`('java.lang.Math', 'abs', 1))",
                "SELECT (SELECT max(o_orderkey) FROM orc.`file:/x`) AS m", "SELECT * FROM no_such_table_here"]:
        with pytest.raises(ReadOnlyViolation):
            assert_read_only(spark, sql)


def test_run_sql_returns_frame(spark):
    df, hit = run_sql(spark, "SELECT 1 AS a UNION ALL SELECT 2")
    assert not hit and sorted(r.a for r in df.collect()) == [1, 2]


def test_execute_structured(spark):
    spark.createDataFrame([(1, "blue"), (2, "red"), (3, "green")], "id int, color string") \
        .createOrReplaceTempView("widget")
    res = execute(spark, "SELECT id, color FROM widget ORDER BY id")
    assert res.row_count == 3 and res.elapsed_ms >= 0
    assert res.columns == [{"name": "id", "type": "int"}, {"name": "color", "type": "string"}]
    assert res.rows[0] == {"id": 1, "color": "blue"} and [r["id"] for r in res.iter_rows()] == [1, 2, 3]


def test_execute_gives_all_rows(spark):
    spark.range(10_005).createOrReplaceTempView("many_rows")
    res = execute(spark, "SELECT id FROM many_rows")
    assert res.row_count == 10_005 and sum(1 for _ in res.iter_rows()) == 10_005


def test_nested_ctes_are_read(spark):
    spark.range(5).createOrReplaceTempView("five")
    df, _ = run_sql(spark, "WITH a AS (SELECT id FROM five), b AS (SELECT * FROM A WHERE id > (SELECT min(id) FROM a)) SELECT count(*) AS n FROM b")
    assert df.first()["n"] == 4


def test_strip_comments(spark):
    assert one(spark, strip_comments, "a /* x\ny */ b -- c\nd") == "a  b \nd"


def _py_collapse(s):
    return " ".join(s.split())


@pytest.mark.parametrize("sql", ["SELECT  1\n\tFROM x ", "  a b c  ", "x"])
def test_hashes_equal_python(spark, sql):
    assert one(spark, sql_log_hash, sql) == hashlib.sha256(_py_collapse(sql).encode()).hexdigest()[:12]
    want = hashlib.sha256((_py_collapse(sql) + "::2024-05-01").encode()).hexdigest()[:24]
    assert one(spark, lambda c: sql_fingerprint(c, "2024-05-01"), sql) == want


def test_token_hash(spark):
    assert one(spark, token_hash, "") == "none"
    assert one(spark, token_hash, None) == "none"
    assert one(spark, token_hash, "abc") == hashlib.sha256(b"abc").hexdigest()[:12]


def test_markdown_table(spark):
    df = spark.createDataFrame([(1, None), (22, "x")], "a int, bb string")
    lines = [r.line for r in markdown_table_lines(df).orderBy("pos").collect()]
    assert lines == ["| a  | bb   |", "| -- | ---- |", "| 1  | NULL |", "| 22 | x    |"]


def test_markdown_rows_keep_their_order(spark):
    spark.range(1000).createOrReplaceTempView("thousand")
    df, _ = run_sql(spark, "SELECT id FROM thousand ORDER BY id DESC")
    got = [(r.pos, r.line) for r in markdown_table_lines(df).orderBy("pos").collect()]
    assert got[2:] == [(2 + i, f"| {str(999 - i).ljust(3)} |") for i in range(1000)]
    none, _ = run_sql(spark, "SELECT id FROM thousand WHERE id < 0")
    assert [r.line for r in markdown_table_lines(none).orderBy("pos").collect()] == ["| id |", "| -- |"]
