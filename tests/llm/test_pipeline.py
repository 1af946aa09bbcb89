"""The pipeline's stages against brute force, and on awkward tables."""
import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabledocs.llm import decontam
from tabledocs.llm.common import written
from tabledocs.session import read_table
from test_operators import SCHEMA, SF, brute_lines, brute_simhash, check_packing, rows

STAGES = dict(corpus_pipeline.STAGES)


def step(spark, name, docs):
    return written(STAGES[name](spark, docs, SF), "test-stage")


def test_whole_run(spark):
    """run() against the stages computed plainly from its recognised documents."""
    docs = read_table(spark, SF, "documents")
    kept = {r["doc_id"]: r["text"] for r in step(spark, "language", docs).collect()}
    assert kept == {r["doc_id"]: r["text"] for r in docs.collect()}  # all are clean
    texts = {i: t for i, _, _, t in brute_lines(list(kept.items()))}
    texts = {i: texts[i] for i, _, c in brute_simhash(list(texts.items())) if i == c}
    items = [decontam.normalise(r["text"]) for r in read_table(spark, SF, "benchmark").collect()]
    leaked = {i for i, t in texts.items() if any(x in decontam.normalise(t) for x in items)}
    got = corpus_pipeline.run(spark, SF).collect()
    ids = {r["doc_id"] for r in got}
    assert not ids & leaked and ids <= texts.keys() and len(texts.keys() - ids - leaked) == 0
    used, least = check_packing(got, [(i, texts[i]) for i in ids])
    assert used <= least + 1


def test_stages_on_awkward_rows(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    for name, _ in corpus_pipeline.STAGES[:-1]:
        out = step(spark, name, docs)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    check_packing(STAGES["packing"](spark, docs, SF).collect(), [r[:2] for r in rows()])
    same = collections.Counter(r["doc_id"] for r in step(spark, "near_duplicates", docs).collect())
    groups = {c for _, _, c in brute_simhash([r[:2] for r in rows()])}
    assert set(same) == groups and set(same.values()) == {1}
    kept = step(spark, "lines", docs)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(((i, t) for i, _, _, t in brute_lines([r[:2] for r in rows()])), key=str)
    assert kept.where(F.col("n_chars") != F.length("text")).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_no_rows(spark, name):
    assert STAGES[name](spark, spark.createDataFrame([], SCHEMA), SF).collect() == []


def test_stages_on_columns_of_any_name_and_type(spark):
    """Dotted, map, variant and clashing columns come out as they went in."""
    data = [(i, f"{t} number {i // 2}", "en", i) for i, t in enumerate(["Some words of a text that is long enough to be a line", "the quick brown fox jumps over the lazy dog today"] * 6)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, i int").selectExpr(
        "doc_id", "text", "lang", "i AS `a.b`", "map('k', i) AS m", "parse_json(concat('{\"v\":', i, '}')) AS v", "i AS __k1", "i AS k1", "'r' AS row", "i AS root", "i AS fp")
    want = {r["doc_id"]: r for r in docs.withColumn("v", F.to_json("v")).collect()}
    for name, _ in corpus_pipeline.STAGES[:-1]:
        out = STAGES[name](spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        rows_ = out.withColumn("v", F.to_json("v")).collect()
        assert rows_, name
        for r in rows_:
            old = want[r["doc_id"]]
            assert all(r[c] == old[c] for c in docs.columns if c != "text"), name
    assert len(STAGES["packing"](spark, docs, SF).collect()) == len(data)
