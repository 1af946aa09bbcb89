"""One key holding a third of all rows: results stay exact, and the plans
pre-aggregate before shuffling (the hot key costs one row per task)."""
from pyspark.sql import functions as F

from conftest import SF01
from tabledocs.operators import checks as C
from tabledocs.operators import search as Q


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _skewed(spark, n=300_000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"),
        (F.col("id") % 7).alias("v")).repartition(16)


def test_unique_hot_key(spark):
    df = _skewed(spark)
    f = C.failing_unique(df, "k")
    rows = f.collect()
    assert len(rows) == 1 and rows[0].k == -1 and rows[0].n_records == 100_000
    plan = _plan(f)
    # partial count runs before the exchange
    assert plan.index("partial_count") > plan.index("Exchange hashpartitioning")


def test_relationships_hot_child_key(spark):
    child = _skewed(spark)
    parent = spark.range(1, 300_000).select(F.col("id").alias("pk"))
    f = C.failing_relationships(child, "k", parent, "pk")
    rows = f.collect()
    # only the hot key -1 (100k rows) has no parent
    assert sorted((r.k, r.n_records) for r in rows) == [(-1, 100_000)]
    plan = _plan(f)
    assert "LeftOuter" in plan and "LeftAnti" not in plan
    assert plan.index("partial_count") > plan.index("Exchange hashpartitioning")


def test_accepted_values_hot_invalid_value(spark):
    df = _skewed(spark).withColumn("s", F.when(F.col("k") == -1, F.lit("bad")).otherwise(F.lit("ok")))
    rows = C.failing_accepted_values(df, "s", ["ok"]).collect()
    assert [(r.s, r.n_records) for r in rows] == [("bad", 100_000)]


def test_batch_search_top_k_cut_map_side(spark):
    docs = Q.as_corpus(spark.read.parquet(f"{SF01}/documents.parquet"), "doc_id", "text")
    out = Q.search_batch(docs, ["e", "thou"], max_results=3)  # "e" hits nearly every document
    got = out.groupBy("keyword").count().collect()
    assert {r.keyword: r["count"] for r in got} == {"e": 3, "thou": 3}
    assert "WindowGroupLimit" in _plan(out) and "Partial" in _plan(out)
