"""Versions of cached tables: published whole, read under leases, swept."""
import os
import threading

from pyspark.sql import functions as F

from conftest import SF01
from tabledocs.plans.sql import execute, markdown_table_lines
from tabledocs.sources.tables import register_folder
from tabledocs.sources.caches import ResultCache, Versions, read_current, write_versioned


def test_put_and_get_at_once(spark, tmp_path):
    """Readers among writers and sweeps always get one whole version."""
    cache = ResultCache(spark, "here", root=str(tmp_path / "sql"))
    table = lambda k: spark.range(200, numPartitions=3).select("id", F.lit(k).alias("k"))
    cache.put("q", table(0))
    seen, wrong, stop = set(), [], threading.Event()

    def write():
        for k in range(1, 6):
            cache.put("q", table(k))
            cache.sweep()
        stop.set()

    def read():
        while not stop.is_set():
            try:
                df = cache.get("q")
                got = [] if df is None else df.groupBy("k").count().collect()
                if len(got) != 1 or got[0]["count"] != 200:
                    wrong.append(got)
                else:
                    seen.add(got[0]["k"])
            except Exception as e:
                wrong.append(e)
    threads = [threading.Thread(target=f) for f in (write, read, read)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not wrong and len(seen) > 1 and cache.get("q").first()["k"] == 5


def test_disk_returns_to_zero(spark, tmp_path):
    root = tmp_path / "sql"
    cache = ResultCache(spark, "here", root=str(root), ttl_seconds=0.0, lease_seconds=0.0)
    for q in "abc":
        cache.put(q, spark.range(10).toDF("x"))
        cache.put(q, spark.range(10).toDF("x"))
    # a write that never finished
    Versions(spark, str(root / "lost")).fs.write_text(str(root / "lost" / "data-1" / "part"), "x")
    assert cache.get("a") is None and cache.sweep() == 7
    assert os.listdir(root) == []


def test_leases_keep_what_is_read(spark, tmp_path):
    root = str(tmp_path / "t")
    assert read_current(spark, root) is None
    write_versioned(spark, spark.range(5).toDF("x"), root)
    old = read_current(spark, root)
    write_versioned(spark, spark.range(7).toDF("x"), root)  # sweeps, but the lease holds
    assert old.count() == 5 and read_current(spark, root).count() == 7
    entry = Versions(spark, root)
    for n in os.listdir(root):
        if n.startswith("lease-"):
            os.remove(os.path.join(root, n))
    assert entry.sweep() == 1 and read_current(spark, root).count() == 7


def test_results_keep_their_order_and_are_run_once(spark, tmp_path):
    register_folder(spark, SF01, ["orders"])
    sql = "SELECT o_orderkey, rand() AS r FROM orders ORDER BY o_totalprice DESC, o_orderkey"
    cache = ResultCache(spark, SF01, root=str(tmp_path / "sql"))
    want = [r.o_orderkey for r in spark.sql("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey").collect()]
    for c in (None, cache, cache):
        res = execute(spark, sql, cache=c)
        first, again = res.rows, res.rows
        assert first == again and [r["o_orderkey"] for r in first] == want and res.row_count == len(want)
    some = execute(spark, "SELECT o_orderkey FROM orders WHERE rand() < 0.5")
    assert some.row_count == len(some.rows)


def test_markdown_plan_is_the_same_for_any_parts(spark):
    for n in (1, 40):
        df = spark.range(200).select((F.col("id") * 7 % 200).alias("x")).repartitionByRange(n, "x").sortWithinPartitions("x")
        lines = [r.line for r in markdown_table_lines(df).orderBy("pos").collect()]
        assert lines == ["| x   |", "| --- |"] + [f"| {i:<3} |" for i in range(200)]
        plan = markdown_table_lines(df)._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 4000
    assert [r.line for r in markdown_table_lines(spark.range(0).toDF("x")).collect()] == ["| x |", "| - |"]
