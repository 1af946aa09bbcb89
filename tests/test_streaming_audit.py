import os

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from tabledocs.operators import audit as A
from tabledocs.sources.caches import ResultCache, load_sample_cache, save_sample_cache
from tabledocs.sources.tables import jdbc_options, jdbc_url, register_folder
from tabledocs.streaming.jobs import audit_stream, guard_stream, protect_stream
from tabledocs.plans.sql import run_sql


def test_protect_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(src))
    q = protect_stream(spark, str(src), "doc_id long, text string", str(tmp_path / "out"),
                       checkpoint=str(tmp_path / "ck"))
    q.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out"))
    from tabledocs.operators.protect import protect
    want = protect(docs)
    assert got.count() == 1000 and got.exceptAll(want).count() == 0


def test_guard_stream(spark, tmp_path):
    src = tmp_path / "sql"
    spark.createDataFrame([("SELECT 1",), ("DROP TABLE x",)], "sql string").write.parquet(str(src))
    guard_stream(spark, str(src), "sql string", "sql", str(tmp_path / "out"),
                 checkpoint=str(tmp_path / "ck")).awaitTermination(300)
    got = {r.sql: r.reason for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["SELECT 1"] is None and "DROP" in got["DROP TABLE x"]


def _events(spark):
    return spark.createDataFrame([
        (1.0, "tool_call_ok", "execute_sql", "h1", None, 10, False, 5),
        (2.0, "tool_call_ok", "execute_sql", "h1", None, 10, True, 15),
        (3.0, "tool_call_rejected", "execute_sql", "h2", 'only SELECT / WITH queries are allowed (got: DROP)',
         None, None, None),
        (4.0, "tool_call_ok", "execute_sql", "h1", None, 10, False, 25)], A.AUDIT_SCHEMA)


def test_audit_lines_round_trip(spark):
    ev = _events(spark)
    for fmt in ("kv", "json"):
        lines = A.event_lines(ev, fmt)
        back = A.parse_lines(lines).drop("extra")
        assert back.exceptAll(ev).count() == 0 and ev.exceptAll(back).count() == 0
    kv = [r.line for r in A.event_lines(ev.where("ts = 3.0"), "kv").collect()][0]
    assert 'reason="only SELECT / WITH queries are allowed (got: DROP)"' in kv and kv.startswith("ts=3.000 ")


def test_rollup(spark):
    r = {x.sql_hash: x for x in A.rollup(_events(spark), exact=True).collect()}
    assert r["h1"].calls == 3 and r["h1"].rejected == 0 and abs(r["h1"].cache_hit_share - 1 / 3) < 1e-9
    assert r["h1"].rows == 30 and r["h1"].p50_ms == 15 and r["h2"].rejected == 1


def test_audit_stream(spark, tmp_path):
    logs = tmp_path / "logs"
    A.event_lines(_events(spark), "kv").write.text(str(logs))
    audit_stream(spark, str(logs), str(tmp_path / "out"), checkpoint=str(tmp_path / "ck")).awaitTermination(300)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_classify_queries(spark):
    q = spark.createDataFrame([("SELECT  1",), ("DELETE FROM t",)], "sql string")
    rows = {r.sql: r for r in A.classify_queries(q).collect()}
    assert rows["SELECT  1"].reason is None and len(rows["SELECT  1"].sql_hash) == 12


def test_result_cache(spark, tmp_path):
    register_folder(spark, SF01, ["orders"])
    cache = ResultCache(spark, SF01, root=str(tmp_path / "sql"))
    sql = "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1"
    df, hit = run_sql(spark, sql, use_cache=True, cache=cache)
    assert not hit and df.count() == 3
    df2, hit2 = run_sql(spark, sql, use_cache=True, cache=cache)
    assert hit2 and sorted(df2.collect()) == sorted(df.collect())
    assert dict(df2.dtypes)["n"] == "bigint"
    # a corrupt entry counts as a miss and goes with the next sweep
    key = tmp_path / "sql" / os.listdir(tmp_path / "sql")[0]
    for ptr in key.glob("v-*.json"):
        ptr.write_text("{not json")
    assert cache.get(sql) is None
    for lease in key.glob("lease-*"):
        lease.unlink()
    cache.sweep()
    assert not list(key.glob("v-*.json"))


def test_sample_cache_versions(spark, tmp_path):
    from tabledocs.operators.samples import CACHE_SCHEMA
    root = str(tmp_path / "samples")
    assert load_sample_cache(spark, root).count() == 0
    rows = spark.createDataFrame([("p", "a.b", 1, "a", "b", "t", "h", "o", [], [{"x": "1"}], ["x"])], CACHE_SCHEMA)
    save_sample_cache(spark, rows, root)
    cur = load_sample_cache(spark, root)
    save_sample_cache(spark, cur.withColumn("fetched_at", F.lit("t2")), root)  # read old while writing new
    assert load_sample_cache(spark, root).first().fetched_at == "t2"


def test_jdbc_settings():
    assert jdbc_url("postgres", "db.example:9999", "w") == "jdbc:postgresql://db.example:5432/w"
    assert jdbc_url("redshift", "rs", "w") == "jdbc:postgresql://rs:5439/w"
    import pytest
    with pytest.raises(ValueError, match="executor.password"):
        jdbc_options("redshift", {"host": "h", "database": "d", "user": "u"}, "t")
    with pytest.raises(ValueError, match="executor.host"):
        jdbc_options("postgres", {"database": "d", "user": "u"}, "t")
    o = jdbc_options("postgres", {"host": "h", "database": "d", "user": "u"}, "t", "id", 0, 100, 4)
    assert o["numPartitions"] == "4" and o["partitionColumn"] == "id"


def test_register_folder_missing(spark):
    import pytest
    with pytest.raises(FileNotFoundError):
        register_folder(spark, "/tmp/no-such-folder-xyz")


def test_event_log_from_execute(spark, tmp_path):
    import pytest
    from tabledocs.plans.sql import ReadOnlyViolation, execute
    log = A.EventLog(spark, str(tmp_path / "audit"))
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("t_one")
    execute(spark, "SELECT a FROM t_one", log=log)
    with pytest.raises(ReadOnlyViolation):
        execute(spark, "DROP TABLE t_one", log=log)
    out = log.flush()
    rows = {r.event: r for r in out.collect()}
    assert rows["tool_call_ok"].row_count == 1 and rows["tool_call_ok"].cache_hit is False
    assert "DROP" in rows["tool_call_rejected"].reason and len(rows["tool_call_rejected"].sql_hash) == 12
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2
    r = {x.sql_hash: x for x in A.rollup(out).collect()}
    assert sum(x.calls for x in r.values()) == 2


def test_connect_lexical_refusals():
    from tabledocs.plans.sql import _REFUSED_LEXICAL
    assert _REFUSED_LEXICAL.search("SELECT TRANSFORM(a) USING 'cat' FROM t")
    assert _REFUSED_LEXICAL.search("SELECT * FROM parquet.`/data/x`")
    assert not _REFUSED_LEXICAL.search("SELECT `my col` FROM t")


@pytest.mark.parametrize("fmt", ["kv", "json"])
def test_free_fields_survive(spark, fmt):
    rows = [(1.5, "call", "ann lee", 'say "a=b"'), (None, "call", None, None)]
    df = spark.createDataFrame(rows, "ts double, event string, user string, note string")
    got = A.parse_lines(A.event_lines(df, fmt))
    assert [(r.event, r.extra) for r in got.collect()] == [("call", {"user": "ann lee", "note": 'say "a=b"'}), ("call", {})]
    again = A.parse_lines(A.event_lines(got, fmt))
    assert again.collect() == got.collect()


def test_streams_without_a_checkpoint_keep_apart(spark, tmp_path):
    for name in ("one", "two"):
        spark.createDataFrame([(f"mail {name}@example.org",)], "note string").write.parquet(str(tmp_path / name))
        protect_stream(spark, str(tmp_path / name), "note string", str(tmp_path / f"{name}-out")).awaitTermination(300)
    for name in ("one", "two"):
        assert spark.read.parquet(str(tmp_path / f"{name}-out")).count() == 1


def test_register_folder_of_any_file_system(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "three.parquet"))
    assert register_folder(spark, f"file://{tmp_path}") == ["three"] and spark.table("three").count() == 3
    with pytest.raises(FileNotFoundError):
        register_folder(spark, f"file://{tmp_path}/none")


def test_repeated_keys_keep_the_last_value(spark):
    lines = spark.createDataFrame([("tool=a event=x tool=b k=1 k=2",), ('{"tool": "a", "event": "x", "k": "1", "tool": "b", "k": "2"}',), ("",), (None,), ("{",)], "line string")
    got = [(r.tool, r.event, r.extra) for r in A.parse_lines(lines).collect()]
    assert got[:2] == [("b", "x", {"k": "2"})] * 2
    assert [g[:2] for g in got[2:]] == [(None, None)] * 3


def test_log_keeps_free_fields(spark):
    log = A.EventLog(spark)
    log.event("tool_call_ok", tool="q", sql="select 1", client="c1", n=3, none=None)
    log.event("other")
    got = log.flush().collect()
    assert got[0].extra == {"client": "c1", "n": "3", "none": None} and got[1].extra == {}
    lines = A.event_lines(spark.createDataFrame([(1.0, "e", {"client": "c 1"})], "ts double, event string, extra map<string,string>"))
    assert A.parse_lines(lines).first().extra == {"client": "c 1"}


def test_daily_states_merge_alike_in_any_split(spark):
    """Few calls are exact; parts of a day merge to the whole; ranges are closed."""
    from pyspark.sql import functions as F
    e = spark.range(600).select((F.col("id") * 3600.0).alias("ts"), F.when(F.col("id") % 10 == 0, "tool_call_rejected").otherwise("tool_call_ok").alias("event"),
                                (F.col("id") % 3).cast("string").alias("sql_hash"), (F.col("id") % 2 == 0).alias("cache_hit"), F.col("id").alias("row_count"),
                                ((F.col("id") * 7919) % 601).alias("elapsed_ms"))
    exact = {r.sql_hash: r for r in A.rollup(e).collect()}
    parts = [A.daily_state(e.where(F.col("ts") % 7200 == k)) for k in (0, 3600)]
    for state in (A.daily_state(e), parts[0].unionByName(parts[1])):
        for r in A.rollup_state(state).collect():
            assert r == exact[r.sql_hash]
    import datetime as dt
    some = A.rollup_state(A.daily_state(e), dt.date(1970, 1, 2), dt.date(1970, 1, 3)).collect()
    assert sum(r.calls for r in some) == 48
    none = A.daily_state(e.where("event <> 'tool_call_ok'"))
    assert {(r.p50_ms, r.cache_hit_share, r["rows"]) for r in A.rollup_state(none).collect()} == {(None, None, None)}


def test_sketched_percentiles_are_bounded(spark):
    from pyspark.sql import functions as F
    n = 200_000
    e = spark.range(n).select((F.col("id") % 40 * 86400.0).alias("ts"), F.lit("tool_call_ok").alias("event"), F.lit("h").alias("sql_hash"), F.lit(True).alias("cache_hit"),
                              F.lit(1).cast("bigint").alias("row_count"), ((F.col("id") * 104_729) % n).alias("elapsed_ms"))
    r = A.rollup_state(A.daily_state(e)).first()
    assert abs(r.p50_ms - 0.5 * n) < 0.01 * n and abs(r.p95_ms - 0.95 * n) < 0.01 * n
