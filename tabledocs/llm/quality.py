"""Quality classifier: regularised quadratic discriminant over transformed
document statistics.

Each class has a mean and a covariance, shrunk towards the pooled covariance
(``pool``) and towards a multiple of the identity (``ridge``). A document's
margin is the difference of the two Gaussian log densities, each a Mahalanobis
distance through a cached Cholesky factor; a logistic curve turns margins into
calibrated probabilities.

How it runs
  1. One pass over the whole texts writes a small row of statistics per
     document; the texts aren't read again.
  2. The statistics of labelled documents are joined with the labels and
     summed up per fold and class (counts, sums, products). All labelled rows
     are used; what reaches the driver is a fixed number of sums.
  3. Shrinkage and calibration are chosen out of fold: each grid point's
     margins under the models of the other folds are counted in bins, by class.
  4. Every document is scored from its statistics, without a shuffle.

Defined results
  null text: like the empty text, which has statistics of its own and a score.
  several labels of a document: the majority; ties and nulls aren't learned
  from. null doc_id: scored, not learned from, held_out false. Repeated rows:
  scored alike, learned from as often as they stand. No label or one class
  only: a constant score. Empty table: empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabledocs.llm.common import prepare, written

FOLDS = 5
POOL = (0.0, 0.1, 0.3, 0.6, 0.9)
RIDGE = (0.001, 0.01, 0.1)
#: Bins of out-of-fold margins, between -RANGE and RANGE.
BINS, RANGE = 1200, 60.0

_UPPER, _LOWER, _DIGIT = (np.array([a <= x <= b for x in range(256)]) for a, b in ((65, 90), (97, 122), (48, 57)))
_STOP = np.isin(np.arange(256), list(b".,;:?'\"()-"))
_MARK = np.isin(np.arange(256), list(b"#$%&*|<>{}[]\\/=+~^@_`"))
_CALL = np.arange(256) == 33
_WIDE = np.arange(256) >= 128
_ODD = re.compile(r"[^\w\s.,;:?!'\"()\-]")
NAMES = ("bytes", "words", "lines", "word_length", "word_spread", "line_length", "upper", "lower", "digit", "stop", "mark", "call", "wide", "entropy",
         "distinct_words", "top_word", "repeated_lines", "short_lines", "ended_lines", "capital_words", "odd_words", "long_words")


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one text: logs of sizes, roots of shares."""
    text = text or ""
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    n = int(counts.sum())
    size = max(n, 1)
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    k, m = max(len(words), 1), max(len(lines), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    p = counts[counts > 0] / size
    share = lambda mask: math.sqrt(counts[mask].sum() / size)
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(len(lines)), math.log1p(lengths.mean()), math.log1p(lengths.std()), math.log1p(n / m),
        share(_UPPER), share(_LOWER), share(_DIGIT), share(_STOP), share(_MARK), share(_CALL), share(_WIDE), float(-(p * np.log(p)).sum()),
        len(seen) / k, math.sqrt(max(seen.values(), default=0) / k), math.sqrt(1 - len(set(lines)) / m) if lines else 0.0,
        math.sqrt(sum(len(x) < 30 for x in lines) / m), math.sqrt(sum(x[-1] in ".!?:;\"'" for x in lines) / m),
        math.sqrt(sum(map(str.isupper, words)) / k), math.sqrt(sum(1 for w, c in seen.items() if _ODD.search(w) for _ in range(c)) / k),
        math.sqrt(float((lengths > 20).mean()))]


def _statistics(batches):
    for batch in batches:
        x = [statistics(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(NAMES)) if len(column) else np.zeros((0, len(NAMES)))


def _sums(batches):
    """Sums of a partition's rows per fold and class: (fold, y, k, v)."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        x, y, f = _matrix(batch.column("x")), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
        for key in set(zip(f.tolist(), y.tolist())):
            own = x[(f == key[0]) & (y == key[1])]
            v = np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
            total[key] = total.get(key, 0) + v
    for (f, y), v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), f, np.int32)), pa.array(np.full(len(v), y, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["fold", "y", "k", "v"])


class Discriminant:
    """Two Gaussian classes with shrunk covariances."""

    def __init__(self, sums: dict[int, np.ndarray], pool: float, ridge: float):
        p = len(NAMES)
        n = [sums[c][0] for c in (0, 1)]
        self.mean = [sums[c][1:p + 1] / n[c] for c in (0, 1)]
        spread = [sums[c][p + 1:].reshape(p, p) - n[c] * np.outer(self.mean[c], self.mean[c]) for c in (0, 1)]
        pooled = (spread[0] + spread[1]) / max(n[0] + n[1] - 2, 1)
        # in units of the pooled standard deviations, so that the ridge means the same everywhere
        self.unit = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
        pooled = pooled / np.outer(self.unit, self.unit)
        self.inverse, self.log_det = [], []
        for c in (0, 1):
            own = spread[c] / max(n[c] - 1, 1) / np.outer(self.unit, self.unit)
            a = max(pool, 1 - n[c] / (4 * p))  # the fewer rows, the more it leans on the pool
            s = (1 - ridge) * ((1 - a) * own + a * pooled)
            s += ridge * max(np.trace(s) / p, 1e-6) * np.eye(p) + 1e-9 * np.eye(p)
            factor = np.linalg.cholesky(s)
            self.inverse.append(np.linalg.inv(factor))
            self.log_det.append(2 * np.log(np.diag(factor)).sum())
        self.prior = math.log(n[1] / n[0])

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for c, sign in ((0, -1), (1, 1)):
            z = ((x - self.mean[c]) / self.unit) @ self.inverse[c].T
            out += sign * -0.5 * ((z * z).sum(1) + self.log_det[c])
        return out


def _bins(batches, models):
    for batch in batches:
        x, y, f = _matrix(batch.column("x")), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
        for g, by_fold in enumerate(models.value):
            for fold in set(f.tolist()):
                own = f == fold
                m = np.clip(by_fold[fold].margins(x[own]), -RANGE, RANGE)
                keys, n = np.unique(np.stack([((m + RANGE) / (2 * RANGE) * (BINS - 1)).round().astype(np.int64), y[own].astype(np.int64)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), g, np.int32)), pa.array(keys[0].astype(np.int32)), pa.array(keys[1].astype(np.int32)), pa.array(n.astype(np.int64))], names=["g", "bin", "y", "n"])


def logistic(m: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, float, float]:
    """(slope, shift, mean loss) of the logistic curve through binned margins,
    by Newton's method with a small penalty."""
    a, b = 0.3, 0.0
    n = pos + neg
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -500, 500)))
        r, w = n * p - pos, n * p * (1 - p) + 1e-9
        grad = np.array([(r * m).sum() + 1e-3 * a, r.sum() + 1e-3 * b])
        hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        scale = min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(a * m + b, -500, 500))), 1e-9, 1 - 1e-9)
    return float(a), float(b), float(-(pos * np.log(p) + neg * np.log(1 - p)).sum() / max(n.sum(), 1))


def _scores(batches, model):
    constant, lda, a, b = model.value
    for batch in batches:
        if lda is None:
            s = np.full(batch.num_rows, constant)
        else:
            s = 1 / (1 + np.exp(-np.clip(a * np.clip(lda.margins(_matrix(batch.column("x"))), -RANGE, RANGE) + b, -500, 500)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])


def _fit(labelled: DataFrame):
    """(constant score, discriminant, slope, shift) from rows (x, y, fold)."""
    spark = labelled.sparkSession
    rows = labelled.mapInArrow(_sums, "fold int, y int, k int, v double").groupBy("fold", "y", "k").agg(F.sum("v").alias("v")).collect()
    width = 1 + len(NAMES) + len(NAMES) ** 2
    sums = {(f, y): np.zeros(width) for f in range(FOLDS) for y in (0, 1)}
    for r in rows:
        sums[r["fold"], r["y"]][r["k"]] = r["v"]
    total = {y: sum(sums[f, y] for f in range(FOLDS)) for y in (0, 1)}
    n = {y: total[y][0] for y in (0, 1)}
    constant = float((n[1] + 1) / (n[0] + n[1] + 2))
    if min(n.values()) < 2:
        return constant, None, 0.0, 0.0
    grid = [(p, r) for p in POOL for r in RIDGE]
    others = [{y: total[y] - sums[f, y] for y in (0, 1)} for f in range(FOLDS)]
    others = [o if min(o[0][0], o[1][0]) >= 2 else total for o in others]
    models = spark.sparkContext.broadcast([[Discriminant(o, p, r) for o in others] for p, r in grid])
    binned = labelled.mapInArrow(partial(_bins, models=models), "g int, bin int, y int, n bigint").groupBy("g", "bin", "y").agg(F.sum("n").alias("n")).collect()
    count = np.zeros((len(grid), BINS, 2))
    for r in binned:
        count[r["g"], r["bin"], r["y"]] = r["n"]
    at = np.linspace(-RANGE, RANGE, BINS)
    fits = [logistic(at, c[:, 1], c[:, 0]) for c in count]
    best = min(range(len(grid)), key=lambda g: fits[g][2])
    return constant, Discriminant(total, *grid[best]), fits[best][0], fits[best][1]


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Per row of ``docs``: doc_id, score, predicted. ``learn``: a condition on
    ``doc_id``; only labels of such documents are learned from."""
    prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    stats = written(base.mapInArrow(_statistics, kind), "statistics")
    marks = (labels.select(F.col(label_id_col).cast("bigint").alias("doc_id"), F.col(label_col).alias("y")).where(learn & F.col("y").isin(0, 1))
             .groupBy("doc_id").agg(F.avg("y").alias("y")).where("y <> 0.5").select("doc_id", (F.col("y") > 0.5).cast("int").alias("y")))
    labelled = written(stats.where(learn).join(marks, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    model = docs.sparkSession.sparkContext.broadcast(_fit(labelled))
    out = stats.mapInArrow(partial(_scores, model=model), "doc_id bigint, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
