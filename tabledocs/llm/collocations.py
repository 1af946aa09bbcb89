"""Phrase collocations by prefix-free parsing: texts are cut into overlapping
chunks where their content says so, distinct chunks form a dictionary with parse
frequencies, and n-grams are counted inside distinct chunks, weighted.

Texts lose the case of A-Z, split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these
at spaces and tabs into words. All counts are per language (null: ``und``).

How it runs
  1. A chunk starts at a word if a hash of that word and the token before it
     says so (every ``EVERY``-th on average, or after ``LONGEST`` words), so equal
     passages give equal chunks wherever they stand. It runs to the next
     start and on for the words that n-grams begun in it still need; only
     n-grams that begin before the next start are its own, so that overlaps count
     once. Grouping equal chunks (partial counts first) gives the dictionary,
     which is written once.
  2. Words are counted, then pairs, then all longer phrases. A phrase of
     ``min_count`` occurrences has only such phrases inside, so pairs are counted
     of words, and longer phrases of pairs, that may be frequent, as a bitmap
     of ``SIEVE_BITS`` bits says: it may let rare phrases pass, never holds a
     frequent one back. The bitmap is all that is broadcast and its size is
     fixed; where it fills up, more is counted and results stay the same.
  3. Candidates meet the counts of their parts, and the longer candidates that
     hold them, by joins on (language, phrase).

Scores are exact: ``floor(2000000 * a / (l + r))`` in decimals.

Defined results
  null text: no words. null language: ``und``, one with that language if given.
  Repeated rows: each counts. Empty table: empty result. Other input columns
  are not read, whatever their names. Very long texts are cut like all others.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabledocs.llm.common import chunks_by_chars, mix64, prepare, quoted, written

#: A chunk start on average every so many words, and at the latest after this many.
EVERY = 24
LONGEST = 256
SIEVE_BITS = 1 << 26
_SLICE = 1 << 16
#: A-Z to a-z, piece ends to newlines, tabs to spaces.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
#: Ids of a piece's end and of a text's end; words follow.
_ENDS = {b"\n": 0, b"\r": 1}


class _Ids(dict):
    """Numbers for words, as they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _hashes(words) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _chunks_of(texts: list[str], reach: int) -> list[tuple[bytes, int]]:
    """The chunks of some texts: (tokens joined by spaces, own words)."""
    raw = b" \r ".join(t.encode("utf-8", "replace").translate(_TABLE) for t in texts).replace(b"\n", b" \n ")
    tokens = [t for t in raw.split(b" ") if t]
    ids = _Ids(_ENDS)
    t = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
    words = np.flatnonzero(t > 1)
    if not len(words):
        return []
    h = _hashes(list(ids))[t]
    # a start by content, or as the first word of a text
    begins = mix64(h * np.uint64(3) + np.concatenate([h[-1:], h[:-1]])) % np.uint64(EVERY) == 0
    begins &= t > 1
    begins[words[np.searchsorted(words, np.flatnonzero(t == 1)).clip(max=len(words) - 1)]] = True
    begins[words[0]] = True
    starts = np.flatnonzero(begins)
    # long stretches without a start: cut after LONGEST tokens
    gaps = np.diff(np.append(starts, len(tokens)))
    if (gaps > LONGEST).any():
        more = [np.arange(s, s + g, LONGEST) for s, g in zip(starts[gaps > LONGEST], gaps[gaps > LONGEST])]
        starts = np.union1d(starts, np.concatenate(more))
    ends = np.append(starts[1:], len(tokens))
    own = np.add.reduceat((t > 1).astype(np.int64), starts)
    stops = np.append(np.flatnonzero(t < 2), len(tokens))
    over = np.minimum(ends + reach, stops[np.searchsorted(stops, ends)])
    # a chunk that ends with its piece needs nothing more, and not the end itself
    last = words[np.searchsorted(words, ends) - 1] + 1
    over = np.where(last < ends, last, over)
    return [(b" ".join(tokens[s:e]), n) for s, e, n in zip(starts.tolist(), over.tolist(), own.tolist()) if n]


def _parse(batches, reach: int):
    """(lang, chunk, own, freq) with equal chunks of a batch counted together."""
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for i, j in chunks_by_chars(texts, 4_000_000):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(langs[i:j], texts[i:j]):
                by_lang.setdefault(lang, []).append(text)
            for lang, own_texts in by_lang.items():
                seen = Counter(_chunks_of(own_texts, reach))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(seen), pa.string()), pa.array([c for c, _ in seen], pa.binary()).cast(pa.string()),
                     pa.array([n for _, n in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["lang", "chunk", "own", "freq"])


def _bucket(h: np.ndarray, size: int) -> np.ndarray:
    return mix64(h) & np.uint64(size - 1)


def _extend(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word."""
    return mix64(h * np.uint64(0x9E3779B97F4A7C15) + word)


def _phrase_hash(lang: int, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases given the hashes of their words, a row each."""
    h = lang
    for k in range(words.shape[1]):
        h = _extend(h, words[:, k])
    return h


def _gathered(batches, size: int = 8 << 20):
    """Batches put together up to some MB, so that more phrases are counted at once."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size and any(b.num_rows for b in held):
            yield pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=1 << 30)[0]
            held, n = [], 0
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=1 << 30)[0]


def _tables(chunks: list[bytes], owns: np.ndarray):
    """(distinct words, word ids, chunk of each token, starts that may be own)."""
    ids = _Ids(_ENDS)
    sizes = np.array([c.count(b" ") + 1 for c in chunks])
    t = np.fromiter(map(ids.__getitem__, b" ".join(chunks).split(b" ")), np.int64, int(sizes.sum()))
    chunk = np.repeat(np.arange(len(chunks)), sizes)
    seen = np.cumsum(t > 1)
    first = np.concatenate([[0], seen[np.cumsum(sizes)[:-1] - 1]])
    own = (t > 1) & (seen - first[chunk] <= owns[chunk])
    return list(ids), t, chunk, own


class _Batch:
    """The tokens of some chunks, and the starts of phrases in them."""

    def __init__(self, batch: pa.RecordBatch, sieve):
        langs = batch.column("lang").dictionary_encode()
        self.langs, self.codes = langs.dictionary, langs.indices.to_numpy().astype(np.int64)
        self.freqs = batch.column("freq").to_numpy()
        self.words, self.t, self.chunk, self.own = _tables(batch.column("chunk").cast(pa.binary()).to_pylist(), batch.column("own").to_numpy())
        if sieve is not None:
            self.bits = np.frombuffer(sieve.value, np.uint8)
            self.hw, self.hl = _hashes(self.words), _hashes([x.encode() for x in self.langs.to_pylist()])

    def may(self, p: np.ndarray, k: int) -> np.ndarray:
        """Whether the phrases of ``k`` words at the positions may be frequent."""
        b = _bucket(_phrase_hash(self.hl[self.codes[self.chunk[p]]], np.stack([self.hw[self.t[p + j]] for j in range(k)], axis=1)), 8 * len(self.bits))
        return (self.bits[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def starts(self, k: int, own: bool = True) -> np.ndarray:
        """The positions of phrases of ``k`` words within a piece and chunk."""
        p = np.flatnonzero(self.own if own else self.t > 1)
        p = p[p + k <= len(self.t)]
        for j in range(1, k):
            p = p[(self.t[p + j] > 1) & (self.chunk[p + j] == self.chunk[p])]
        return p


def _count(batches, lengths: tuple[int, ...], sieve, m: int):
    """(lang, words, phrase, f) of the phrases of those lengths of which each ``m``
    words in a row may be frequent."""
    for rows in _gathered(batches):
        b = _Batch(rows, sieve)
        may = np.ones(len(b.t) + 1, bool)
        if m:
            may[:] = False
            p = b.starts(m, own=False)
            may[p[b.may(p, m)]] = True
        for k in lengths:
            p = b.starts(k)
            for j in range(k - m + 1 if m else 0):
                p = p[may[p + j]]
            if not len(p):
                continue
            # equal phrases of the batch together: ids of ever longer phrases
            key, weight = b.codes[b.chunk[p]], b.freqs[b.chunk[p]]
            for j in range(k):
                key = pd.factorize(key * len(b.words) + b.t[p + j])[0]
            n = int(key.max()) + 1
            at = np.empty(n, np.int64)
            at[key] = np.arange(len(key))  # some place of each phrase
            total = np.bincount(key, weights=weight, minlength=n) if weight.sum() < 1 << 52 else _exact(key, weight, n)
            spelled = pa.array(b.words, pa.binary()).cast(pa.string())
            parts = [spelled.take(pa.array(b.t[p[at] + j])) for j in range(k)]
            phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, " ")
            yield pa.RecordBatch.from_arrays([b.langs.take(pa.array(b.codes[b.chunk[p[at]]])), pa.array(np.full(n, k, np.int32)), phrase, pa.array(total.astype(np.int64))],
                                             names=["lang", "words", "phrase", "f"])


def _exact(key, weight, n):
    total = np.zeros(n, np.int64)
    np.add.at(total, key, weight)
    return total


def _sieve_buckets(batches, size):
    """(slice, bit) of each phrase."""
    for batch in batches:
        langs = _hashes([x.encode() for x in batch.column("lang").to_pylist()])
        out = np.zeros(len(langs), np.uint64)
        phrases = [x.encode().split(b" ") for x in batch.column("phrase").to_pylist()]
        if phrases:
            out = _bucket(_phrase_hash(langs, np.array([[xxhash.xxh64_intdigest(w) for w in x] for x in phrases], np.uint64)), size)
        at = np.unique(out.astype(np.int64)) if phrases else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((at // _SLICE).astype(np.int32)), pa.array((at % _SLICE).astype(np.int32))], names=["slice", "bit"])


def _slice_bits(table: pa.Table) -> pa.Table:
    bits = np.zeros(_SLICE, np.uint8)
    bits[table.column("bit").to_numpy()] = 1
    return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def _sieve(frequent: DataFrame, size: int):
    """The bitmap of the frequent phrases of one level, as a broadcast of ``size`` bits."""
    slices = (frequent.select("lang", "phrase").mapInArrow(partial(_sieve_buckets, size=size), "slice int, bit int").distinct()
              .groupBy("slice").applyInArrow(_slice_bits, "slice int, bits binary").toLocalIterator())
    bits = bytearray(size // 8)
    for row in slices:
        bits[row["slice"] * _SLICE // 8:(row["slice"] + 1) * _SLICE // 8] = row["bits"]
    return frequent.sparkSession.sparkContext.broadcast(bytes(bits))


def phrase_dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 4) -> DataFrame:
    """The distinct chunks: lang, chunk, own (words whose phrases are its own), freq."""
    prepare(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(quoted(lang_col)), F.lit("und")).alias("lang"), F.col(quoted(text_col)).alias("text")).where(F.col("text") != "")
    return (texts.mapInArrow(partial(_parse, reach=max_words - 1), "lang string, chunk string, own int, freq bigint")
            .groupBy("lang", "chunk", "own").agg(F.sum("freq").alias("freq")))


def phrase_counts(chunks: DataFrame, max_words: int, min_count: int, sieve_bits: int = SIEVE_BITS) -> DataFrame:
    """lang, phrase, words, f of all phrases with at least ``min_count`` occurrences."""
    out, sieve = None, None
    # words, pairs, then all longer ones in one pass, as few of their pairs are frequent
    for m, lengths in enumerate(((1,), (2,), tuple(range(3, max_words + 1)))):
        if lengths and lengths[0] <= max_words:
            level = written(chunks.mapInArrow(partial(_count, lengths=lengths, sieve=sieve, m=m), "lang string, words int, phrase string, f bigint")
                            .groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count), f"phrases-{lengths[0]}")
            out = level if out is None else out.unionByName(level)
            sieve = _sieve(level, sieve_bits) if lengths[-1] < max_words else None
    return out


def _part(words: Column, first: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 4, min_count: int = 30,
                 contained: int = 80, top: int | None = 2000, sieve_bits: int = SIEVE_BITS) -> DataFrame:
    """Each language's phrases of two to ``max_words`` words: lang, rank,
    phrase, a, l, r, n, score; ``top`` None gives all, without a rank.
    ``sieve_bits`` is a power of two, at least 65,536."""
    chunks = written(phrase_dictionary(docs, text_col, lang_col, max_words), "phrase-chunks")
    totals = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("freq")).alias("n"))
    counts = phrase_counts(chunks, max_words, min_count, sieve_bits)
    parts = counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("of_part"))
    found = counts.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("w"))

    # the cut that scores lowest
    cuts = found.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), 1, F.col("k")).alias("head"), _part(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    cuts = (cuts.join(parts.select("lang", F.col("part").alias("head"), F.col("of_part").alias("l")), ["lang", "head"])
            .join(parts.select("lang", F.col("part").alias("tail"), F.col("of_part").alias("r")), ["lang", "tail"]))
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r)")
    best = (cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
            .groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut")))

    # the most frequent longer phrase that holds a phrase
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: _part(F.col("w"), i, m))))
    longer = (found.where("words >= 3").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = (best.join(longer, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | F.expr(f"cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {int(contained)}")))
    if top is None:
        ranked = kept.withColumn("rank", F.lit(None))
    else:  # cut to the first ranks in each task before the shuffle
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase")))
        ranked = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
