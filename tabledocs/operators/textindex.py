"""Keyword search over a written trigram index of a corpus.

The index is a folder of Parquet tables, one set per batch of documents:

  docs      doc, name, text
  postings  gram, docs, chunk, bucket (a folder): documents holding a trigram of
            the lowered text. A row covers the documents of one chunk (some MB of
            texts, called by its first document), so it is bounded and a trigram
            that most documents hold is many rows; rows are dealt to files by
            gram and chunk, so no task gets one whole.
  grams     gram, df: in how many documents a trigram is

A search takes from ``grams`` what its keywords' trigrams need, reads the
postings of the rarest ``probes`` of each keyword, intersects them chunk by
chunk and tests only the lowered texts of documents holding them all. Lines,
summaries and snippets are made of the first documents alone. The cost is that
of the postings and documents met, not of documents times keywords. Results are those of
:func:`..operators.search.search_batch`; nothing is approximate.

A batch counts once its commit file stands, which is written last: a build that
fails or is repeated leaves nothing visible. Keywords of under three
characters have no trigram and are tested against all texts.

Defined results: null texts and texts of under three characters have no
trigram (short keywords find the latter); equal names stay apart; an empty
corpus gives an index without hits.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed import SEARCH_MAX_RESULTS
from ..session import list_folder, parallelism
from .search import LINE_BREAKS, found_hits, name_order, needle_of

BUCKETS = 32
PROBES = 3
#: Characters whose trigrams are gathered at once in a task.
_CHARS = 4_000_000


def gram_keys(text: str) -> np.ndarray:
    """The distinct trigrams of a text: 21 bits for each code point."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def _postings(batches, buckets: int):
    """(gram, docs, chunk, bucket, part): a row for each trigram of some MB of texts."""
    number = 0
    for batch in batches:
        docs, texts = batch.column("doc").to_numpy(), batch.column("low").to_pylist()
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= _CHARS):
                size += len(texts[j])
                j += 1
            keys = [gram_keys(t) for t in texts[i:j]]
            own, chunk = np.repeat(docs[i:j], [len(k) for k in keys]), docs[i]
            i = j
            if not len(own):
                continue
            gram = np.concatenate(keys)
            order = np.argsort(gram, kind="stable")
            gram, own = gram[order], own[order]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(gram)) + 1])
            grams = gram[cut]
            lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(own)).astype(np.int32)), pa.array(own))
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array(grams), lists, pa.array(np.full(len(grams), chunk, np.int64)), pa.array(_bucket(grams, buckets)), pa.array(np.full(len(grams), number, np.int32))],
                                             names=["gram", "docs", "chunk", "bucket", "part"])


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    mixed = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)


def _holding_all(lists: pa.Table, chosen: list[tuple[str, list[int]]]) -> pa.Table:
    """(batch, doc, found) of one chunk: its documents with the keywords whose
    trigrams they all hold."""
    held = dict(zip(lists.column("gram").to_pylist(), (x.values.to_numpy() for x in lists.column("docs"))))
    docs, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for number, (_, grams) in enumerate(chosen):
        if all(g in held for g in grams):
            both = held[grams[0]]
            for g in grams[1:]:
                both = np.intersect1d(both, held[g], assume_unique=True)
            docs.append(both)
            numbers.append(np.full(len(both), number, np.int64))
    docs, numbers = np.concatenate(docs), np.concatenate(numbers)
    order = np.argsort(docs, kind="stable")
    docs, numbers = docs[order], numbers[order]
    cut = np.flatnonzero(np.diff(docs, prepend=-1))
    names = pa.array([n for n, _ in chosen], pa.string()).take(pa.array(numbers))
    found = pa.ListArray.from_arrays(pa.array(np.append(cut, len(docs)).astype(np.int32)), names)
    return pa.table({"batch": pa.array(np.full(len(cut), lists.column("batch")[0].as_py(), np.int32)), "doc": pa.array(docs[cut], pa.int64()), "found": found})


def _held(batches):
    """(batch, doc, name, keyword): the keywords that lowered texts do hold."""
    for b in batches:
        held = [[k for k in found if k in low] for low, found in zip(b.column("low").to_pylist(), b.column("found").to_pylist())]
        rows = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in held]))
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in ("batch", "doc", "name")), pa.array([k for x in held for k in x], pa.string())],
                                         names=["batch", "doc", "name", "keyword"])


class TrigramIndex:
    """A trigram index in the folder ``path`` of any file system Spark reads."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # ── building ──

    def _commits(self) -> list[int]:
        return sorted(int(n) for n in list_folder(self.spark, f"{self.path}/commits") or [] if n.isdigit())

    def append(self, corpus: DataFrame) -> int:
        """Add the documents ``(name, text)`` as a new batch; its number.
        One writer at a time; readers see the batch when it is whole."""
        begun = [int(n.split("=")[1]) for n in list_folder(self.spark, f"{self.path}/docs") or [] if n.startswith("batch=")]
        number = max([*begun, *self._commits(), -1]) + 1
        docs_path, postings_path = (f"{self.path}/{t}/batch={number}" for t in ("docs", "postings"))
        corpus.select(F.monotonically_increasing_id().alias("doc"), "name", "text").write.parquet(docs_path)
        docs = self.spark.read.parquet(docs_path)
        spread = max(1, 2 * parallelism(self.spark) // self.buckets)
        (docs.where(F.length("text") >= 3).select("doc", F.lower("text").alias("low"))
         .mapInArrow(partial(_postings, buckets=self.buckets), "gram bigint, docs array<bigint>, chunk bigint, bucket int, part int")
         .repartition(self.buckets * spread, "bucket", F.pmod("part", F.lit(spread))).sortWithinPartitions("bucket", "gram").select("gram", "docs", "chunk", "bucket")
         .write.partitionBy("bucket").parquet(postings_path))
        # read back with the schema: a batch without any text has no files
        (self.spark.read.schema("gram bigint, docs array<bigint>, bucket int").parquet(postings_path)
         .groupBy("gram").agg(F.sum(F.size("docs")).alias("df")).write.parquet(f"{self.path}/grams/batch={number}"))
        self._commit(number)
        return number

    def _commit(self, number: int) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{number}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, False).close()

    # ── reading ──

    def _table(self, name: str, schema: str | None = None) -> DataFrame | None:
        out = None
        for n in self._commits():
            reader = self.spark.read.schema(schema) if schema else self.spark.read
            one = reader.parquet(f"{self.path}/{name}/batch={n}").withColumn("batch", F.lit(n))
            out = one if out is None else out.unionByName(one)
        return out

    def documents(self) -> DataFrame | None:
        """``(doc, name, text, batch)`` of all committed batches."""
        return self._table("docs")

    def _rarest(self, needles: list[str], probes: int) -> list[tuple[str, list[int]]]:
        """(needle, its rarest trigrams); needles that no document can hold are left out."""
        keys = {n: gram_keys(n).tolist() for n in needles}
        wanted = self.spark.createDataFrame([(g,) for g in sorted({g for k in keys.values() for g in k})], "gram bigint")
        grams = self._table("grams", "gram bigint, df bigint")
        # no more rows than the keywords have trigrams
        df = {r["gram"]: r["df"] for r in grams.join(F.broadcast(wanted), "gram").groupBy("gram").agg(F.sum("df").alias("df")).collect()}
        return [(n, sorted(k, key=lambda g: (df[g], g))[:probes]) for n, k in keys.items() if all(g in df for g in k)]

    def candidates(self, needles: list[str], probes: int = PROBES) -> DataFrame | None:
        """``(batch, doc, found)``: documents with the needles whose rarest trigrams they hold."""
        chosen = self._rarest(needles, probes)
        if not chosen:
            return None
        grams = sorted({g for _, k in chosen for g in k})
        probe = self.spark.createDataFrame([(g,) for g in grams], "gram bigint")
        buckets = sorted(set(_bucket(np.array(grams, np.int64), self.buckets).tolist()))
        lists = self._table("postings", "gram bigint, docs array<bigint>, chunk bigint, bucket int").where(F.col("bucket").isin(buckets))
        # the probes are the caller's own list, at most ``probes`` rows a keyword; a
        # chunk's lists hold no more than the trigrams of its texts
        held = lists.join(F.broadcast(probe), "gram").select("batch", "chunk", "gram", "docs")
        return held.groupBy("batch", "chunk").applyInArrow(lambda t: _holding_all(t, chosen), "batch int, doc bigint, found array<string>")

    def search(self, keywords: list[str], max_results: int | None = SEARCH_MAX_RESULTS, probes: int = PROBES) -> DataFrame:
        """``(keyword, name, description, match_count, snippets)``; per keyword the
        first ``max_results`` documents by name (``None``: all hits)."""
        needles = sorted({needle_of(k) for k in keywords})
        if not needles:
            raise ValueError("no keyword was given")
        docs = self.documents()
        if docs is None:
            raise LookupError(f"no index at {self.path}")
        needles = [n for n in needles if not set(n) & LINE_BREAKS]  # no line holds another
        short, long = [n for n in needles if len(n) < 3], [n for n in needles if len(n) >= 3]
        candidates = self.candidates(long, probes) if long else None
        # a needle is in some line exactly when it is in the lowered text
        may = docs.withColumn("found", F.lit(short)) if short else None
        if candidates is not None:
            by_index = docs.join(candidates, ["batch", "doc"])
            may = by_index if may is None else may.unionByName(by_index)
        if may is None:
            may = docs.where(F.lit(False)).withColumn("found", F.array().cast("array<string>"))
        if max_results is None:
            return found_hits(may)
        pairs = (may.where(F.col("text").isNotNull()).select("batch", "doc", "name", F.lower("text").alias("low"), "found")
                 .mapInArrow(_held, f"batch int, doc bigint, name {docs.schema['name'].dataType.simpleString()}, keyword string"))
        # no more rows than keywords times results: only these documents are split into lines
        first = first_hits(pairs, docs, max_results).groupBy("batch", "doc").agg(F.collect_list("keyword").alias("found"))
        return found_hits(docs.join(first, ["batch", "doc"]))


def first_hits(hits: DataFrame, corpus: DataFrame, max_results: int) -> DataFrame:
    """Per keyword the first documents by name (cut in each task before the exchange)."""
    rank: Column = F.row_number().over(Window.partitionBy("keyword").orderBy(name_order(corpus)))
    return hits.withColumn("rn", rank).where(F.col("rn") <= max(1, max_results)).drop("rn")
