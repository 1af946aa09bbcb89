"""Document corpus: listing, summaries and keyword search over ``(name, text)``.

Search is a case-insensitive substring match per line (not word-boundary:
``invoice`` hits ``fct_invoice_line``). It counts matching *lines* and keeps
the first five, stripped and cut to 200 characters. Every step is a
projection or filter over each document, so a corpus of any size is searched
with no shuffle; only the top-k per keyword needs one, and that is cut
map-side by the window group limit before the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import (INDEX_FILE, PY_WS_CLASS, SEARCH_MAX_RESULTS, SEARCH_MAX_SNIPPETS,
                               SEARCH_SNIPPET_MAX_LEN, SUMMARY_MAX_LEN)
from ..functions.strings import cut, file_lines, let, py_strip, split_lines


def as_corpus(df: DataFrame, name_col: str, text_col: str) -> DataFrame:
    """Any ``(id, text)`` table as a corpus; the index document is skipped,
    documents without a name are kept."""
    return (df.select(F.col(name_col).alias("name"), F.col(text_col).alias("text"))
            .where(~F.col("name").cast("string").eqNullSafe(F.lit(INDEX_FILE.removesuffix(".md")))))


# A line that, once stripped, is non-empty and does not start with ``#``.
_SUMMARY_LINE = "^" + PY_WS_CLASS + "*[^#" + PY_WS_CLASS[1:-1] + "]"
# The first line when it already qualifies (the common case: no split needed).
_FIRST_LINE = "\\A" + PY_WS_CLASS.replace("\\n", "").replace("\\r", "") + "*([^#" + \
    PY_WS_CLASS[1:-1] + "][^\\r\\n]*)"


def summary_line(text) -> Column:
    """First stripped line that is non-empty and not a heading, cut to 200
    characters (no ellipsis); empty string when there is none.

    When the first line qualifies it is taken directly; otherwise the text is
    split into lines and the first qualifying line is found with an anchored
    test (only that one line is stripped)."""
    t = F.col(text) if isinstance(text, str) else text
    head = F.regexp_extract(t, _FIRST_LINE, 1)
    later = F.get(F.filter(file_lines(t), lambda l: l.rlike(_SUMMARY_LINE)), 0)
    first = F.when(head != "", head).otherwise(later)
    return F.coalesce(F.substring(py_strip(first), 1, SUMMARY_MAX_LEN), F.lit(""))


def name_order(corpus: DataFrame) -> Column:
    """Sort key of documents: text names sort as their file names do
    (``<name>.md``, so ``a.b`` comes before ``a``); numeric ids by value."""
    if isinstance(corpus.schema["name"].dataType, T.StringType):
        return F.concat(F.col("name"), F.lit(".md"))
    return F.col("name")


def list_documents(corpus: DataFrame) -> DataFrame:
    """``(name, description)`` for every document, sorted by name."""
    return (corpus.select("name", summary_line("text").alias("description"))
            .orderBy(name_order(corpus)))


def read_document(corpus: DataFrame, name: str) -> DataFrame:
    """One document by name; names that could leave a folder are refused, and
    an unknown one is an error (a lookup that stops at the first hit)."""
    if any(part in name for part in ("/", "\\", "..")):
        raise ValueError(f"not a document name: {name!r}")
    found = corpus.where(F.col("name").cast("string") == F.lit(name)).select("name", "text")
    if found.isEmpty():
        raise LookupError(f"no document is called {name!r}")
    return found


def needle_of(keyword: str) -> str:
    k = (keyword or "").strip()
    if not k:
        raise ValueError("a keyword needs a character that is no blank")
    return k.lower()


def _snippets(matching: Column) -> Column:
    return F.transform(F.slice(matching, 1, SEARCH_MAX_SNIPPETS),
                       lambda s: cut(py_strip(s), SEARCH_SNIPPET_MAX_LEN))


LINE_BREAKS = set("\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029")


def _matching(corpus: DataFrame, needle: str) -> DataFrame:
    """Documents holding the needle. A needle without line breaks occurs in
    some line exactly when it occurs in the lowered text, so that cheap test
    is the only filter (it may run at the scan). A needle holding a line
    break can match no line."""
    if set(needle) & LINE_BREAKS:
        corpus = corpus.where(F.lit(False))
    return corpus.where(F.contains(F.lower(F.col("text")), F.lit(needle)))


def _details(docs: DataFrame, needle: str) -> DataFrame:
    """``(name, description, match_count, snippets)``; lines split once."""
    m = F.filter(split_lines(F.col("text")), lambda l: F.contains(F.lower(l), F.lit(needle)))
    return (docs.select("name", "text", m.alias("m"))
            .select("name", summary_line("text").alias("description"),
                    F.size("m").alias("match_count"), _snippets(F.col("m")).alias("snippets")))


def search_hits(corpus: DataFrame, keyword: str) -> DataFrame:
    """Every matching document: ``(name, description, match_count, snippets)``."""
    needle = needle_of(keyword)
    return _details(_matching(corpus, needle), needle)


def search(corpus: DataFrame, keyword: str, max_results: int = SEARCH_MAX_RESULTS) -> DataFrame:
    """Matching documents ordered by name, at most ``max_results`` (a limit of
    zero or less still returns the first hit). The top documents are chosen
    on the cheap match test first; lines, summaries and snippets are then
    computed for those documents only."""
    needle = needle_of(keyword)
    top = (_matching(corpus, needle).orderBy(name_order(corpus)).limit(max(1, max_results))
           .repartition(1))
    # The top-k is one top-n per task and a small merge (TakeOrderedAndProject);
    # the one-partition repartition of its (at most k) rows keeps the detail
    # projection above it, so only those rows are split into lines.
    return _details(top, needle).sortWithinPartitions(name_order(top))


# ─── many keywords ──────────────────────────────────────────────────────────

def scan_hits(corpus: DataFrame, needles: list[str]) -> DataFrame:
    """One row per document and keyword found in it. The keywords are one
    array value, so the plan is the same for any number of them; a document's
    lowered text is tested against each."""
    def found(low: Column) -> Column:
        return F.filter(F.lit(needles), lambda k: F.contains(low, k))

    return found_hits(corpus.select("name", "text", let(F.lower(F.col("text")), found).alias("found")).where(F.size("found") > 0))


def found_hits(docs: DataFrame) -> DataFrame:
    """``(keyword, name, description, match_count, snippets)`` of documents
    with the keywords they may hold (``found``): lines are split and lowered
    once, and only those keywords are looked up in them."""
    def lookup(lines: Column) -> Column:
        return F.transform("found", lambda k: F.struct(
            k.alias("keyword"), F.filter(lines, lambda l: F.contains(l.getField("low"), k)).alias("m")))

    lines = F.transform(split_lines(F.col("text")), lambda l: F.struct(l.alias("raw"), F.lower(l).alias("low")))
    return (docs.select("name", summary_line("text").alias("description"), F.inline(let(lines, lookup))).where(F.size("m") > 0)
            .select("keyword", "name", "description", F.size("m").alias("match_count"),
                    _snippets(F.transform("m", lambda x: x.getField("raw"))).alias("snippets")))


def search_batch(corpus: DataFrame, keywords: list[str], max_results: int | None = SEARCH_MAX_RESULTS
                 ) -> DataFrame:
    """Many keywords over a corpus: ``(keyword, name, description, match_count,
    snippets)``; per keyword the first ``max_results`` documents by name
    (``None`` keeps all hits)."""
    needles = sorted({needle_of(k) for k in keywords})
    if not needles:
        raise ValueError("no keyword was given")
    hits = scan_hits(corpus, needles)
    if max_results is None:
        return hits
    w = Window.partitionBy("keyword").orderBy(name_order(corpus))
    return (hits.withColumn("rn", F.row_number().over(w))
            .where(F.col("rn") <= max(1, max_results)).drop("rn"))
