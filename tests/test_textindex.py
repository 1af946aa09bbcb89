"""The trigram index against the search that reads every document."""
import random

import pytest

from tabledocs.operators import search as Q
from tabledocs.operators import textindex as X


def corpus(spark, seed=2, n=400):
    r = random.Random(seed)
    words = ["Invoice", "éTé", "日本語", "a", "thing", "things", "İx", "x\ty", "no.", "-", "ΑΣ", "\U0001F600ok"]
    rows = [(f"d{i % 390}", r.choice(["\n", " ", "\r\n", "\x85"]).join(r.choice(words) for _ in range(r.randrange(30)))) for i in range(n)]
    rows += [("none", None), (None, "a thing without a name"), ("empty", ""), ("two", "hi"), ("long", "thing " * 200_000 + "needle")]
    return spark.createDataFrame(rows, "name string, text string").repartition(4)


def rows(df):
    return sorted(((r["keyword"], r["name"], r["description"], r["match_count"], tuple(r["snippets"])) for r in df.collect()), key=str)


KEYWORDS = ["thing", " INVOICE ", "hi", "a", "été", "日本語", "needle", "absent", "thingx", "ok -", "no. a", "x\ty", "a\nb", "\U0001F600", "things thing", "g t", "xy"]


@pytest.mark.parametrize("most", [None, 1, 3])
def test_same_as_the_scan(spark, tmp_path, most):
    docs = corpus(spark)
    index = X.TrigramIndex(spark, str(tmp_path / "index"), buckets=5)
    index.append(docs.where("coalesce(name, '') < 'd2'"))
    index.append(docs.where("coalesce(name, '') >= 'd2'"))
    for probes in (1, 3):
        got = rows(index.search(KEYWORDS, max_results=most, probes=probes))
        want = rows(Q.search_batch(docs, KEYWORDS, max_results=most))
        if most is None:
            assert got == want
        else:  # names that repeat may tie
            assert [(k, n) for k, n, *_ in got] == [(k, n) for k, n, *_ in want]


def test_batches_count_once_whole(spark, tmp_path, monkeypatch):
    docs = corpus(spark, n=40)
    index = X.TrigramIndex(spark, str(tmp_path / "index"))
    with pytest.raises(LookupError, match="no index"):
        index.search(["thing"])
    index.append(docs)
    before = rows(index.search(["thing"], max_results=None))

    def fails(self, number):
        raise OSError("lost")
    with monkeypatch.context() as m:
        m.setattr(X.TrigramIndex, "_commit", fails)
        with pytest.raises(OSError):
            index.append(docs)
    assert rows(index.search(["thing"], max_results=None)) == before
    assert index.append(docs) == 2
    assert len(index.search(["thing"], max_results=None).collect()) == 2 * len(before)


def test_empty_corpus(spark, tmp_path):
    index = X.TrigramIndex(spark, str(tmp_path / "index"))
    index.append(spark.createDataFrame([], "name string, text string"))
    index.append(spark.createDataFrame([("a", None), ("b", "xy")], "name string, text string"))
    assert index.search(["thing", "zz"]).collect() == []
    assert [r["name"] for r in index.search(["xy"]).collect()] == ["b"]
    with pytest.raises(ValueError):
        index.search([])


def test_lookup_reads_few_postings(spark, tmp_path):
    """Only the buckets of the probed trigrams are read, and no join of texts by keyword."""
    index = X.TrigramIndex(spark, str(tmp_path / "index"))
    index.append(corpus(spark))
    plan = index.candidates(["needle"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1][:300]


def test_lines_of_the_first_documents_alone(spark, tmp_path):
    """Candidates aren't dealt out as a row for each document and keyword, and
    only the documents of the first hits are split into lines."""
    index = X.TrigramIndex(spark, str(tmp_path / "index"))
    index.append(spark.range(300).selectExpr("id as name", "concat('thing and things ', id) as text"))
    plan = index.candidates(["thing", "things"])._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "explode" not in plan
    found = index.search(["thing", "things", "and things 299"], max_results=2)
    assert sorted((r["keyword"], r["name"]) for r in found.collect()) == [("and things 299", 299), ("thing", 0), ("thing", 1), ("things", 0), ("things", 1)]
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("inline") < text.index("MapInArrow") and "row_number" in text
