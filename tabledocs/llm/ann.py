"""Approximate nearest neighbours by multi-index hashing.

Vectors become 64-bit codes: centred, rotated by a learned rotation (iterative
quantisation: principal directions, then the rotation under which signs lose
least), one bit per sign. A code is cut into eight substrings, each with a
bucket table of its own. All codes within Hamming radius r of a query agree
with it up to floor(r / 8) bits in one substring at least, so probing the
buckets within that distance finds every one of them; the found codes within
the radius are ranked by the exact Euclidean distance of the floats.

How it runs
  1. Rotation and radius are fitted on a bounded sample (``fit_rows`` vectors
     by hash, of them ``fit_queries`` queries): the radius is the least one
     within which ``target`` of the sample's true neighbours lie. On more rows
     neighbours are nearer, so that recall doesn't fall.
  2. All vectors are dealt evenly into shards of about ``SHARD`` rows, all
     queries into blocks of at most about ``BLOCK``; a task holds one shard
     with its bucket tables and one block of queries, and gives the best ``k``
     of its shard for each query.
  3. The best of all shards per query are its neighbours. A shard in which
     fewer than ``k`` codes lie within the radius widens it for that query
     until ``k`` are found or all its rows are, so that no query stays short.

Defined results
  vectors null, empty, zero, or holding null or non-finite components, and
  rows without vec_id: take no part, neither as query nor as candidate.
  Vectors of each dimension are searched among their own, with codes of their
  own. Rows that share a vec_id stay rows of their own: a query's candidates
  are all rows but its own, and each row that is a query has its ranks. Equal
  vectors: each is a candidate; ties go to the smaller vec_id. Fewer than k
  candidates: all of them. Empty table: empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabledocs.llm.common import quoted, unit_hash, written

BITS, PARTS = 64, 8
SHARD, BLOCK = 16_384, 4096


class Codes:
    """Learned rotated binary codes."""

    def __init__(self, x: np.ndarray, seed: int = 7, rounds: int = 30):
        dim = x.shape[1]
        self.mean = x.mean(axis=0)
        c = x - self.mean
        rng = np.random.default_rng(seed)
        # principal directions; where there are fewer than bits, random ones of the same space
        _, vectors = np.linalg.eigh(c.T @ c / max(len(c), 1) + 1e-12 * np.eye(dim))
        self.project = vectors[:, ::-1][:, :BITS]
        if dim < BITS:
            more = rng.standard_normal((dim, BITS - dim))
            self.project = np.hstack([self.project, more / np.linalg.norm(more, axis=0)])
        v = c @ self.project
        q, _ = np.linalg.qr(rng.standard_normal((BITS, BITS)))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ q >= 0, 1.0, -1.0).T @ v)
            q = (u @ w).T
        self.matrix = self.project @ q

    def __call__(self, x: np.ndarray) -> np.ndarray:
        bits = (x - self.mean) @ self.matrix >= 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


class MultiIndex:
    """Bucket tables of the substrings of a shard's codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        parts = codes[:, None].view(np.uint8).reshape(-1, PARTS)
        self.order = [np.argsort(parts[:, p], kind="stable") for p in range(PARTS)]
        self.cuts = [np.searchsorted(parts[o, p], np.arange(257)) for p, o in enumerate(self.order)]
        values = np.arange(256, dtype=np.uint8)
        self.apart = np.bitwise_count(values[:, None] ^ values[None, :])

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Positions of all codes within ``radius`` bits of ``code``."""
        near = self.apart[np.array([code]).view(np.uint8)] <= radius // PARTS
        mark = np.zeros(len(self.codes), bool)
        for p in range(PARTS):
            order, cuts = self.order[p], self.cuts[p]
            for b in np.flatnonzero(near[p]):
                mark[order[cuts[b]:cuts[b + 1]]] = True
        found = np.flatnonzero(mark)
        return found[np.bitwise_count(self.codes[found] ^ code) <= radius]


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = x - q
    return np.sqrt((d * d).sum(axis=1))


def nearest(index: MultiIndex, ids: np.ndarray, keys: np.ndarray, x: np.ndarray, own: int, q: np.ndarray, code: np.uint64, k: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` (ids, distances) of the shard for the query whose row is ``own``."""
    while True:
        found = index.within(code, radius)
        found = found[keys[found] != own]
        if len(found) >= k or radius >= BITS:
            break
        radius += 4
    d = _distances(q, x[found])
    best = np.lexsort((ids[found], d))[:k]
    return ids[found[best]], d[best]


def _vectors(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def fit(x: np.ndarray, queries: int, k: int, target: float) -> tuple[Codes, int]:
    """Codes, and the radius within which ``target`` of true neighbours lie."""
    codes = Codes(x)
    c = codes(x)
    step = max(1, len(x) // max(queries, 1))
    apart = []
    norms = (x * x).sum(axis=1)
    for i in range(0, len(x), step):
        d = norms - 2 * (x @ x[i])
        d[i] = np.inf
        best = np.argpartition(d, min(k, len(d) - 1))[:k] if len(d) > k else np.flatnonzero(np.isfinite(d))
        apart.append(np.bitwise_count(c[best] ^ c[i]))
    all_apart = np.sort(np.concatenate(apart)) if apart else np.zeros(0, np.uint8)
    return codes, int(all_apart[min(len(all_apart) - 1, math.ceil(target * len(all_apart)))]) if len(all_apart) else BITS


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", fit_rows: int = 20_000, fit_queries: int = 500, target: float = 0.98) -> DataFrame:
    """Per query its ``k`` nearest found: query_id, rank, vec_id, score.
    ``is_query``: a condition on ``vec_id``."""
    spark = vectors.sparkSession
    good = (F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
            & F.exists("v", lambda e: e != 0))
    rows = (vectors.select(F.col(quoted(id_col)).cast("bigint").alias("vec_id"), F.col(quoted(vector_col)).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull()).where(F.coalesce(good, F.lit(False))))
    # rows alike in id and vector differ by a number
    rows = rows.groupBy("vec_id", "v").agg(F.count("*").alias("n")).select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    rows = written(rows.select("vec_id", "v", F.xxhash64("vec_id", "v", "copy").alias("key")), "vectors")
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("queries")).orderBy("dim").collect()
    found = None
    for r in sizes:
        if r["queries"]:
            part = _search(rows.where(F.size("v") == r["dim"]), is_query, r["dim"], r["n"], r["queries"], k, fit_rows, fit_queries, target)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    order = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, is_query: Column, dim: int, n: int, n_queries: int, k: int, fit_rows: int, fit_queries: int, target: float) -> DataFrame:
    """The best ``k`` of every shard for each query among vectors of one dimension."""
    spark = rows.sparkSession
    sample = rows.where(unit_hash(F.lit("fit"), "key") < fit_rows / n).select("v").toArrow()
    if not len(sample):
        sample = rows.limit(fit_rows).select("v").toArrow()
    model = spark.sparkContext.broadcast(fit(_vectors(sample.column("v"), dim), fit_queries, k, target))
    shards, blocks = math.ceil(n / SHARD), max(1, math.ceil(n_queries / BLOCK))
    deal = lambda what, m: F.floor(unit_hash(F.lit(what), "key") * m).cast("int")
    base = rows.withColumn("shard", deal("shard", shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = rows.where(is_query).withColumn("block", deal("block", blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, keys, x = left.column("vec_id").to_numpy(), left.column("key").to_numpy(), _vectors(left.column("v"), dim)
        names, own, q = right.column("vec_id").to_numpy(), right.column("key").to_numpy(), _vectors(right.column("v"), dim)
        codes, radius = model.value
        out: list[tuple[np.ndarray, ...]] = []
        if len(ids) and len(own):
            index = MultiIndex(codes(x))
            for i, code in enumerate(codes(q)):
                found, d = nearest(index, ids, keys, x, own[i], q[i], code, k, radius)
                out.append((np.full(len(found), names[i]), np.full(len(found), own[i]), found, d))
        cat = lambda j, t: np.concatenate([o[j] for o in out]) if out else np.zeros(0, t)
        return pa.table({"query_id": pa.array(cat(0, np.int64)), "query": pa.array(cat(1, np.int64)), "vec_id": pa.array(cat(2, np.int64)), "score": pa.array(cat(3, np.float64))})

    return base.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(search, "query_id bigint, query bigint, vec_id bigint, score double")
