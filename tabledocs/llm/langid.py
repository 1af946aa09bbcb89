"""Language identification with character language models.

One interpolated Kneser-Ney 4-gram model over letters per language, stored in
sorted arrays of n-gram hashes (one array per order, a column of log
probabilities per language). A text's language is the one with the lowest
cross-entropy per character; a calibrated limit rejects texts that are unlike
all learned languages.

How it runs
  1. Per language a bounded sample of its labelled documents (about
     ``sample_docs``, a classifier's bound), chosen by a hash of id and text, is
     counted: n-grams per batch first, then per language. All languages are
     learned, and all their n-grams: none is cut.
  2. The model (the sample's distinct 4-grams with a value a language) is
     computed on the driver and broadcast. Every text is scored whole, in one
     pass without a shuffle.
  3. The sample is dealt into ``FOLDS`` folds by a hash of the text; each fold
     is scored by a model learned from the others, at every size alike. Sums
     over the rows give the sharpness that turns differences of cross-entropy
     into the probability of the chosen language, and for each language the
     mean and spread of its documents' cross-entropy. A text is rejected if no
     letter is in it, or if its cross-entropy lies more than ``REJECT_SD``
     standard deviations and ``REJECT_NATS`` above its language's mean (the
     spread allows for the text's length). A language's spread is shrunk
     towards that of all, and its mean towards the highest, as if
     ``PRIOR_ROWS`` rows said so: the fewer held-out rows, the more.

Defined results
  null text, text without a letter: ``und``, score 0, rejected.
  nothing to learn from: every text is ``und``, score 0, rejected.
  null or empty lang: not learned from. null doc_id: predicted, not learned
  from, held_out false. Repeated rows count as often as they stand.
  Ties between languages: the first in code-point order. Empty table: empty.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabledocs.llm.common import chunks_by_chars, mix64, prepare, quoted, row_of, unit_hash

ORDER = 4
REJECT_SD = 8.0
REJECT_NATS = 1.0
FOLDS = 5
PRIOR_ROWS = 20
GRID = (0.5, 1, 2, 4, 8, 16, 32, 64)
_MASK = [np.uint64((1 << (16 * k)) - 1) for k in range(ORDER + 1)]


class _Letters:
    """Lower-case letter of each code point in 16 bits; 32 for all others."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            out = np.full(0x110000, 32, np.uint16)
            for x in range(0x110000):
                c = chr(x)
                if c.isalpha():
                    low = ord(c.lower()[0])
                    # beyond the basic plane: folded, never onto the blank
                    out[x] = low if low < 0x10000 else 0xE000 + low % 0x1900
            cls.table = out
        return cls.table


def letter_runs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one code array, each with three blanks before it and one
    behind, runs of non-letters as one blank. Also the texts' bounds in it."""
    table = _Letters.get()
    sep = "\x00" * ORDER
    codes = np.frombuffer(("".join(sep + (t or "") for t in texts) + sep).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter((len(t or "") + ORDER for t in texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    low = table[codes]
    blank = low == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank after a letter
    lead = (starts[:, None] + np.arange(1, ORDER)[None, :]).ravel()  # three blanks before a text
    keep[lead[lead < len(keep)]] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    return low[keep], at[starts + 1]  # the blank behind a text is its own


def grams(codes: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each position from the fourth on, packed in 64 bits."""
    c = codes.astype(np.uint64)
    n = len(c) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(16)) | c[k:k + n]
    return out


def text_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams of all texts one after another, and each text's bounds.
    A text without letters has none."""
    codes, at = letter_runs(texts)
    out = grams(codes)
    # a text's first gram starts at its blanks; its last ends at its last character
    first = at[:-1]
    last = np.maximum(first, at[1:] - ORDER + 1)
    keep = np.zeros(len(out) + 1, np.int64)
    np.add.at(keep, first[first < last], 1)
    np.add.at(keep, last[first < last], -1)
    mask = np.cumsum(keep)[:len(out)] > 0
    pos = np.concatenate(([0], np.cumsum(mask)))
    return out[mask], np.concatenate((pos[first[:1]], pos[last])) if len(texts) else np.zeros(1, np.int64)


# ---------------------------------------------------------------- the model

class _Table:
    """Sorted hash array of packed n-grams with a row of values per n-gram."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = mix64(keys)
        order = np.argsort(h)
        self.keys, self.values = h[order], np.ascontiguousarray(values[order])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, row) of each packed n-gram."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        h = mix64(keys)
        i = np.searchsorted(self.keys, h)
        i[i == len(self.keys)] = 0
        return self.keys[i] == h, i


def _discount(counts: np.ndarray) -> float:
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    return float(np.clip(n1 / (n1 + 2 * n2), 0.1, 0.95)) if n1 else 0.5


class Model:
    """Kneser-Ney models of several languages over packed letter n-grams."""

    def __init__(self, langs: list[str], counted: dict[str, tuple[np.ndarray, np.ndarray]], uniform: float | None = None):
        """``counted``: per language its distinct 4-grams and their counts.
        ``uniform``: a letter's probability below the lowest order, else by
        the letters counted."""
        self.langs = langs
        L = len(langs)
        stats = [self._orders(*counted[x]) for x in langs]
        letters = np.unique(np.concatenate([s[1][0] for s in stats])) if L else np.zeros(0, np.uint64)
        self.uniform = uniform or 1.0 / (len(letters) + 1)
        self.tables: dict[int, _Table] = {}
        self.backoff: dict[int, _Table] = {}
        self.unseen = np.zeros(L)
        for k in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([s[k][0] for s in stats])) if L else np.zeros(0, np.uint64)
            context = np.unique(keys >> np.uint64(16)) if k > 1 else np.zeros(1, np.uint64)
            prob = np.zeros((len(keys), L))
            weight = np.ones((len(context), L))  # of the lower order; 1 for unseen contexts
            lower = self._prob(k - 1, keys & _MASK[k - 1]) if k > 1 else np.full((len(keys), L), self.uniform)
            for j, s in enumerate(stats):
                own, n = s[k]
                d = _discount(n)
                ctx, inverse = np.unique(own >> np.uint64(16), return_inverse=True) if k > 1 else (np.zeros(1, np.uint64), np.zeros(len(own), np.int64))
                total = np.bincount(inverse, weights=n, minlength=len(ctx))
                kinds = np.bincount(inverse, minlength=len(ctx))
                at = np.searchsorted(context, ctx)
                weight[at, j] = np.where(total > 0, d * kinds / np.maximum(total, 1), 1)
                prob[np.searchsorted(keys, own), j] = np.maximum(n - d, 0) / np.maximum(total[inverse], 1)
            prob += weight[np.searchsorted(context, keys >> np.uint64(16) if k > 1 else np.zeros(len(keys), np.uint64))] * lower
            self.tables[k] = _Table(keys, np.log(prob).astype(np.float32))
            self.backoff[k] = _Table(context, np.log(weight).astype(np.float32))

    @staticmethod
    def _orders(keys: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """4-grams with counts; lower orders with their numbers of left neighbours."""
        out = {ORDER: (keys, n.astype(np.float64))}
        for k in range(ORDER - 1, 0, -1):
            short, kinds = np.unique(out[k + 1][0] & _MASK[k], return_counts=True)
            out[k] = (short, kinds.astype(np.float64))
        return out

    def _prob(self, k: int, keys: np.ndarray) -> np.ndarray:
        return np.exp(self.log_prob(k, keys).astype(np.float64))

    def log_prob(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Log probability of the last letter after the others, per language."""
        if k == 0:
            return np.full((len(keys), len(self.langs)), np.log(self.uniform), np.float32)
        found, i = self.tables[k].find(keys)
        out = self.tables[k].values[i] if len(self.tables[k].keys) else np.zeros((len(keys), len(self.langs)), np.float32)
        miss = np.flatnonzero(~found)
        if len(miss):
            left = keys[miss]
            low = self.log_prob(k - 1, left & _MASK[k - 1])
            seen, c = self.backoff[k].find(left >> np.uint64(16) if k > 1 else np.zeros(len(left), np.uint64))
            low[seen] += self.backoff[k].values[c[seen]]
            out[miss] = low
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: its number of scored characters, and its cross-entropy a
        character under each language (nats)."""
        n, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)))
        for i, j in chunks_by_chars(texts):
            g, at = text_grams(texts[i:j])
            n[i:j] = np.diff(at)
            for k in range(0, len(g), 500_000):
                part = self.log_prob(ORDER, g[k:k + 500_000])
                cut = np.clip(at, k, k + len(part)) - k
                sums = np.concatenate((np.zeros((1, part.shape[1])), np.cumsum(part, axis=0, dtype=np.float64)))
                total[i:j] += sums[cut[1:]] - sums[cut[:-1]]
        return n, -total / np.maximum(n, 1)[:, None]


# ---------------------------------------------------------------- the jobs

def _count(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        groups: dict = {}
        for t, key in zip(texts, zip(batch.column("lang").to_pylist(), batch.column("fold").to_pylist())):
            groups.setdefault(key, []).append(t)
        out = []
        for (x, f), own in groups.items():
            for i, j in chunks_by_chars(own):
                keys, n = np.unique(text_grams(own[i:j])[0], return_counts=True)
                out.append((x, f, keys, n))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _, k, _ in out for _ in range(len(k))], pa.string()),
             pa.array([f for _, f, k, _ in out for _ in range(len(k))], pa.int32()),
             pa.array(np.concatenate([k for *_, k, _ in out]).view(np.int64) if out else [], pa.int64()),
             pa.array(np.concatenate([n for *_, n in out]) if out else [], pa.int64())], names=["lang", "fold", "gram", "n"])


#: What is summed over held-out rows: entropies and their squares, by weights
#: (none, 1/n, least of n and 1000), then the loss at each sharpness of GRID.
MEASURES = ("rows", "own", "own2", "short", "short2", "own_short", "own2_short", "weight", "own_weight", *(f"loss_{i}" for i in range(len(GRID))))


def measures(n: np.ndarray, own: np.ndarray, e: np.ndarray, true: np.ndarray) -> np.ndarray:
    """A row of MEASURES per text of n characters, with cross-entropy ``own`` under
    its language (number ``true``) and ``e`` under each."""
    short, weight = 1 / n, np.minimum(n, 1000)
    loss = [-np.log(np.maximum(Calibration._posterior(e, n, s)[np.arange(len(n)), true], 1e-12)) for s in GRID]
    return np.stack([np.ones(len(n)), own, own * own, short, short * short, own * short, own * own * short, weight, own * weight, *loss], axis=1)


def _held_out(batches, models, langs):
    """MEASURES of the texts of each fold, by the model without it."""
    number = {x: j for j, x in enumerate(langs)}
    for batch in batches:
        lang, folds, texts = (batch.column(c).to_pylist() for c in ("lang", "fold", "text"))
        names, rows = [], [np.zeros((0, len(MEASURES)))]
        for f in sorted(set(folds)):
            model = models[f].value
            known = set(model.langs)
            at = [i for i, x in enumerate(folds) if x == f and lang[i] in known]
            n, some = model.entropies([texts[i] for i in at])
            e = np.full((len(at), len(langs)), np.inf)  # a language without other folds is none
            e[:, [number[x] for x in model.langs]] = some
            true = np.array([number[lang[i]] for i in at], np.int64)
            full = n > 0
            n, e, true = n[full].astype(np.float64), e[full], true[full]
            rows.append(measures(n, e[np.arange(len(n)), true], e, true))
            names += [langs[j] for j in true]
        x = np.concatenate(rows)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(len(MEASURES)))], names=["lang", *MEASURES])


class Calibration:
    """Sharpness of the confidence, and the limits of rejection."""

    def __init__(self, langs: list[str], sums: dict[str, np.ndarray], uniform: float = 1.0):
        """``sums``: per language the MEASURES of its held-out texts, summed."""
        L = len(langs)
        x = np.array([sums.get(lang, np.zeros(len(MEASURES))) for lang in langs]).reshape(L, len(MEASURES))
        rows, own, own2, short, short2, own_short, own2_short, weight, own_weight = x[:, :9].T
        held = rows > 0
        self.sharpness = np.float64(20.0)
        # without any held-out text: worse than guessing letters
        self.mean, self.between, self.within = np.full(L, -np.log(uniform) - REJECT_NATS), np.full(L, 0.05), np.full(L, 4.0)
        if not held.any():
            return
        self.sharpness = np.float64(GRID[int(np.argmin(x[:, 9:].sum(axis=0)))])
        mean = own_weight / np.where(held, weight, 1)
        # off = between + within / n, by least squares, neither negative
        off = own2 - 2 * mean * own + mean ** 2 * rows
        off_short = own2_short - 2 * mean * own_short + mean ** 2 * short
        lean = lambda value, count, prior: (value * count + prior * PRIOR_ROWS) / (count + PRIOR_ROWS)
        between = lambda o, n: np.maximum(0.02 ** 2, o / np.maximum(n, 1))
        within = lambda o, s: np.maximum(1.0, o / np.maximum(s, 1e-300))
        all_between = lean(between(off.sum(), rows.sum()), rows.sum(), 0.05)
        all_within = lean(within(off_short.sum(), short2.sum()), rows.sum(), 4.0)
        self.between, self.within = lean(between(off, rows), rows, all_between), lean(within(off_short, short2), rows, all_within)
        self.mean = lean(mean, rows, mean[held].max())

    @staticmethod
    def _posterior(e: np.ndarray, n: np.ndarray, s: float) -> np.ndarray:
        """From cross-entropies; evidence grows with the root of the length, as
        neighbouring characters aren't independent."""
        x = -e * s * np.sqrt(n)[:, None]
        x -= x.max(axis=1, keepdims=True)
        p = np.exp(x)
        return p / p.sum(axis=1, keepdims=True)

    def judge(self, n: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: the language's number, its probability, rejected."""
        best = e.argmin(axis=1)
        score = self._posterior(e, n, self.sharpness)[np.arange(len(n)), best]
        over = e[np.arange(len(n)), best] - self.mean[best]
        sd = np.sqrt(self.between[best] + self.within[best] / np.maximum(n, 1))
        return best, score, (over > REJECT_NATS) & (over > REJECT_SD * sd)


def _predict(batches, model, calibration: Calibration):
    langs = np.array(model.value.langs + ["und"], object)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        n, e = model.value.entropies(texts)
        # letters leave more than the blanks around a text
        some = n > 0
        if e.shape[1]:
            best, score, rejected = calibration.judge(np.maximum(n, 1).astype(np.float64), e)
        else:
            some &= False
            best, score, rejected = np.zeros(len(n), np.int64), np.zeros(len(n)), np.ones(len(n), bool)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("text"), pa.array(langs[np.where(some, best, len(langs) - 1)], pa.string()),
             pa.array(np.where(some, score, 0.0)), pa.array(np.where(some, rejected, True))],
            names=["row", "text", "lang_pred", "score", "rejected"])


def identify_languages(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 5000) -> DataFrame:
    """Per row of ``docs``: ``row`` (a struct of all columns but the text),
    ``text``, lang_pred, score, rejected. ``learn``: the rows to learn from."""
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    lang, text = F.col(quoted(lang_col)), F.col(quoted(text_col))
    own = docs.where(F.coalesce(learn, F.lit(False)) & lang.isNotNull() & (lang != "") & text.isNotNull())
    sizes = own.groupBy(lang.alias("lang")).agg(F.count("*").alias("docs"))
    u = unit_hash(F.lit("language"), F.col(quoted(id_col)).cast("string"), text)
    # copies of a text share a fold
    fold = F.floor(unit_hash(F.lit("fold"), text) * FOLDS).cast("int").alias("fold")
    # a row for each language, as the model has a column for each
    chosen = (own.select(lang.alias("lang"), text.alias("text"), fold, u.alias("u")).join(F.broadcast(sizes), "lang")
              .where(F.col("u") * F.col("docs") < sample_docs).select("lang", "fold", "text"))
    counts = (chosen.mapInArrow(_count, "lang string, fold int, gram bigint, n bigint").groupBy("lang", "gram")
              .agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in range(FOLDS)]))
    counted, without = {}, [{} for _ in range(FOLDS)]
    for x, t in counts.toPandas().groupby("lang"):
        keys = t["gram"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        keys, n = keys[order], t["n"].to_numpy(np.int64)[order]
        counted[x] = (keys, n)
        for f in range(FOLDS):
            left = n - t[f"n{f}"].to_numpy(np.int64)[order]
            if (left > 0).any():
                without[f][x] = (keys[left > 0], left[left > 0])
    langs = sorted(counted)
    full = Model(langs, counted)
    model, sums = spark.sparkContext.broadcast(full), {}
    if langs:
        models = [spark.sparkContext.broadcast(Model(sorted(m), m, full.uniform)) for m in without]
        rows = chosen.mapInArrow(partial(_held_out, models=models, langs=langs), "lang string, " + ", ".join(f"{m} double" for m in MEASURES))
        sums = {r["lang"]: np.array(r[1:]) for r in rows.groupBy("lang").agg(*[F.sum(m).alias(m) for m in MEASURES]).collect()}
        for m in models:
            m.destroy()
    calibration = Calibration(langs, sums, full.uniform)
    base = docs.select(row_of(docs, text_col), text.alias("text"))
    out = T.StructType([base.schema["row"], T.StructField("text", T.StringType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return base.mapInArrow(partial(_predict, model=model, calibration=calibration), out)
