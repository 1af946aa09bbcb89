import pytest
from pyspark.sql import functions as F

from conftest import SF01, one
from tabledocs.functions.strings import first_sentence, split_lines
from tabledocs.operators import search as Q

DOCS = {
    "_index": "# Schema index\n\nprod.dim_widget prod.fct_invoice_line",
    "prod.dim_widget": "# `prod.dim_widget` (model)\n\nDimension of every widget. One row per widget.\n\n"
                       "### widget_id\n- Tests: unique\n### Color\nWidget COLOR values.\n",
    "prod.fct_cancellation": "# `prod.fct_cancellation` (model)\n\nCancellations of subscriptions.\n"
                             "### cancel_reason\n- Type: `varchar`\n",
    "prod.fct_invoice_line": "\n  \n# head\n   Invoice lines, one per item.   \n" + "invoice x\n" * 7,
}


@pytest.fixture(scope="module")
def corpus(spark):
    return Q.as_corpus(spark.createDataFrame(list(DOCS.items()), "name string, text string"), "name", "text")


def test_list_skips_index_and_summarises(corpus):
    rows = Q.list_documents(corpus).collect()
    assert [r.name for r in rows] == ["prod.dim_widget", "prod.fct_cancellation", "prod.fct_invoice_line"]
    assert rows[0].description == "Dimension of every widget. One row per widget."
    assert rows[2].description == "Invoice lines, one per item."


def test_search_case_insensitive_substring(corpus):
    rows = Q.search(corpus, "  COLOR ").collect()
    assert [r.name for r in rows] == ["prod.dim_widget"]
    assert rows[0].match_count == 2 and rows[0].snippets == ["### Color", "Widget COLOR values."]


def test_search_fragments_and_stems(corpus):
    assert [r.name for r in Q.search(corpus, "invoice").collect()] == ["prod.fct_invoice_line"]
    assert [r.name for r in Q.search(corpus, "cancel").collect()] == ["prod.fct_cancellation"]


def test_search_snippet_cap_and_limit(corpus):
    r = Q.search(corpus, "invoice").first()
    assert r.match_count == 8 and len(r.snippets) == 5
    assert r.snippets[:2] == ["Invoice lines, one per item.", "invoice x"]
    assert Q.search(corpus, "prod", max_results=0).count() == 1
    assert Q.search(corpus, "prod", max_results=2).count() == 2


def test_search_empty_keyword(corpus):
    with pytest.raises(ValueError):
        Q.search(corpus, "   ")


def test_snippet_cut(spark):
    c = Q.as_corpus(spark.createDataFrame([("a", "  " + "k" * 250 + "  ")], "name string, text string"),
                    "name", "text")
    snip = Q.search(c, "k").first().snippets[0]
    assert snip == "k" * 200 + "…"


def test_read_document(corpus):
    assert Q.read_document(corpus, "prod.dim_widget").count() == 1
    for bad in ["../etc/passwd", "a/b", "a\\b"]:
        with pytest.raises(ValueError):
            Q.read_document(corpus, bad)
    with pytest.raises(LookupError, match="dim_nothing"):
        Q.read_document(corpus, "dim_nothing")


def test_batch_equals_single_searches(spark):
    docs = Q.as_corpus(spark.read.parquet(f"{SF01}/documents.parquet"), "doc_id", "text")
    kws = ["thou", "eau", "ungs", "schön", "@", "http", "license", "the end", "zz", "a\nb"]
    key = lambda r: (r.keyword, r.name, r.match_count, tuple(r.snippets), r.description)
    one = [r for k in kws for r in Q.search_hits(docs, k).withColumn("keyword", F.lit(k)).collect()]
    assert sorted(map(key, Q.search_batch(docs, kws, max_results=None).collect())) == sorted(map(key, one))


@pytest.mark.parametrize("extra", [0, 70])
def test_batch_gives_a_result_per_row_at_any_number_of_keywords(spark, extra):
    c = Q.as_corpus(spark.createDataFrame([("a", "same text"), ("a", "same text"), (None, "text too")], "name string, text string"), "name", "text")
    got = Q.search_batch(c, ["text"] + [f"none{i}" for i in range(extra)], max_results=None).collect()
    assert sorted((r.name or "", r.match_count) for r in got) == [("", 1), ("a", 1), ("a", 1)]


def test_first_sentence(spark):
    cases = {"Dimension of every widget. One row.": "Dimension of every widget.",
             "e.g. this. And": "e.g.", "No dot at all": "No dot at all", "  a\n\nb.c  ": "a b.",
             "": "", None: ""}
    for text, want in cases.items():
        assert one(spark, lambda c: first_sentence(F.col(c) if isinstance(c, str) else c), text) == want


def test_split_lines_like_python(spark):
    for text in ["a\nb", "a\n", "", "\n", "a\r\nb\rc\x0bd\x1ce f", "a\n\n"]:
        assert one(spark, split_lines, text) == text.splitlines()


def test_py_title(spark):
    from tabledocs.functions.strings import py_title
    for text in ["feature flags", "feature-flags", "1st kind", "ÉVÉNEMENTS d'été", "abc", "", "x_y"]:
        assert one(spark, py_title, text) == text.title(), text


def test_names_sort_like_file_names(spark):
    c = Q.as_corpus(spark.createDataFrame([("a", "x y"), ("a.b", "x z"), ("b", "x")], "name string, text string"),
                    "name", "text")
    assert [r.name for r in Q.list_documents(c).collect()] == ["a.b", "a", "b"]
    assert [r.name for r in Q.search(c, "x").collect()] == ["a.b", "a", "b"]
    assert {r.name for r in Q.search_batch(c, ["x"], max_results=2).collect()} == {"a.b", "a"}
