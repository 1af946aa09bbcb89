"""Benchmark decontamination by pigeonhole edit matching.

A document is contaminated by a test item if some part of it is within the
item's error budget (edit distance over normalised text). An item with budget
k is split into k + 1 pieces: k edits can't touch all of them, so at least one
piece stands in the document exactly. Piece hits are found by hash, and each
is verified with Myers' bit-parallel distance over the window around it.

Normalised text: lower-cased, each run of characters that are neither letters
nor digits as one blank. Items longer than ``SEGMENT`` characters are cut into
even segments, each of which is tested as an item of its own; so are parts of
``PART`` characters, one from every ``STEP``-th character on, of each item
longer than that. So a leaked passage of ``PART + STEP - 1`` characters holds a
part, wherever in the item it begins. Items of fewer than ``FEW_WORDS`` words
and ``SHORT`` characters (kind ``short``; all others ``edit``) are matched
without edits and between word bounds; next to a letter of a script without
blanks between words none is asked for.

How it runs
  Items are read in blocks of bounded size (``BLOCK_CHARS``; one block for
  common benchmarks) and each block's index (piece hashes and items) is
  broadcast. A block takes one pass over the documents, without a shuffle: a
  rolling hash of 16, 8, 4, 2 and 1 characters at every position is looked up
  in a bitmap, then in sorted arrays, and only true piece hits are verified.
  All texts of an item id are in one block, so a row's matches are whole
  there and no grouping follows. Texts over ``WINDOW`` characters are read in
  windows that overlap by more than an item's reach.

Defined results
  null or empty text, null or empty item: never a match. Items of fewer than
  ``min_words`` words take no part (0, as the query and the stage have it: all
  take part). Each row is matched by itself, with null or repeated ids too. Each
  item without id is an item of its own. An item's segments and repeated items
  give one match per row and item_id, of the least distance. Empty tables: no
  matches. ``decontaminate`` takes a short item for a leak only where it is the
  document's whole text: words like those stand in clean documents.
"""

from __future__ import annotations

import math
import re
from array import array
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabledocs.llm.common import chunks_by_chars, prepare, quoted, row_of

SEGMENT = 256
PART, STEP = 40, 16
FEW_WORDS, SHORT = 5, 24
BLOCK_CHARS = 4_000_000
WINDOW = 1_000_000
_APART = re.compile(r"[\W_]+")
_SIZES = (16, 8, 4, 2, 1)
_BASE = 0x100000001B3
_BITS = 22
#: Letters of scripts without blanks between words: Thai, Lao, Tibetan, Burmese, Khmer, Chinese, Japanese.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u312f\u3190-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def normalise(text: str | None) -> str:
    return _APART.sub(" ", (text or "").lower()).strip()


def segments(item: str) -> list[str]:
    """Even cuts of at most SEGMENT characters, and overlapping parts of PART."""
    n = math.ceil(len(item) / SEGMENT)
    cuts = [round(i * len(item) / n) for i in range(n + 1)] if n else [0]
    last = len(item) - PART
    starts = [*range(0, last, STEP), last] if last > 0 else []
    return list(dict.fromkeys([item[i:j] for i, j in zip(cuts[:-1], cuts[1:])] + [item[i:i + PART] for i in starts]))


def budget(length: int, rate: float) -> int:
    return int(length * rate)


def pieces(length: int, k: int) -> list[tuple[int, int]]:
    """Bounds of the k + 1 pieces of an item of ``length`` characters."""
    cuts = [round(i * length / (k + 1)) for i in range(k + 2)]
    return list(zip(cuts[:-1], cuts[1:]))


def myers(pattern: str, text: str, limit: int) -> int:
    """The least edit distance of ``pattern`` to any part of ``text`` if it is
    at most ``limit``, else some number above it (Myers' bit-vector algorithm;
    a part may begin and end anywhere)."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for left, c in zip(range(len(text), 0, -1), text):
        if score - left >= min(best, limit + 1):
            break  # each character lowers the distance by one at most
        eq = peq.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & full  # a part may begin anywhere: no 1 is shifted in
        mh = mh << 1 & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
    return best


def rolling(codes: np.ndarray, longest: int = _SIZES[0]) -> dict[int, np.ndarray]:
    """Per size of _SIZES: the hash of the characters from each position on."""
    h = codes.astype(np.uint64) + np.uint64(1)
    h *= np.uint64(0x9E3779B97F4A7C15)
    out, power, size = {1: h}, _BASE, 1
    while size < longest:
        h = h[:max(0, len(h) - size)] * np.uint64(power) + h[size:]
        power = power * power % (1 << 64)
        size *= 2
        out[size] = h
    return out


def windows(text: str) -> list[str]:
    """A text in parts of about WINDOW characters, between blanks where there
    are any, that overlap by more than any segment with its edits."""
    if len(text) <= WINDOW:
        return [text]
    out, start = [], 0
    while start + WINDOW < len(text):
        end = text.find(" ", start + WINDOW, start + WINDOW + 1000)
        end = start + WINDOW if end < 0 else end
        out.append(text[start:end])
        back = text.rfind(" ", end - 2 * SEGMENT - 1000, end - 2 * SEGMENT)
        start = end - 2 * SEGMENT if back < 0 else back + 1
    return [*out, text[start:]]


class Index:
    """Pieces of a block of items: per hash size a bitmap, the sorted hashes,
    and the piece each belongs to."""

    def __init__(self, items, rate: float, min_words: int):
        self.ids: list = []  # of the items
        self.items: list[tuple[int, str, int]] = []  # segments: number of the item, characters, budget
        self.short: list[bool] = []  # per item
        segment, bounds, words_at = array("l"), array("l"), array("b")  # per piece
        # per hash size: hash of a piece's first characters, the piece, offset and hash of its last characters
        own: dict[int, tuple[array, array, array, array]] = {}
        numbers: dict = {}
        for item_id, text in items:
            clean = normalise(text)
            words = clean.count(" ") + 1
            if not clean or words < min_words:
                continue
            short = words < FEW_WORDS and len(clean) < SHORT
            number = numbers.setdefault((item_id, clean if item_id is None else short), len(self.ids))
            if number == len(self.ids):
                self.ids.append(item_id)
                self.short.append(short)
            for s in [clean] if short else segments(clean):
                k = 0 if short else budget(len(s), rate)
                hashes = rolling(np.frombuffer(s.encode("utf-32-le"), np.uint32))
                for a, b in pieces(len(s), k):
                    size = next((q for q in _SIZES if q <= b - a), None)
                    if size:
                        x = own.setdefault(size, (array("Q"), array("l"), array("l"), array("Q")))
                        x[0].append(int(hashes[size][a]))
                        x[1].append(len(segment))
                        x[2].append(b - a - size)
                        x[3].append(int(hashes[size][b - size]))
                    segment.append(len(self.items))
                    bounds.extend((a, b))
                    # whether a word must begin, and end, there
                    words_at.append((short and not _UNSPACED.match(clean[0])) + 2 * (short and not _UNSPACED.match(clean[-1])))
                self.items.append((number, s, k))
        self.segment, self.bounds, self.words_at = np.array(segment), np.array(bounds).reshape(-1, 2), np.array(words_at, np.int8)
        self.once = np.array([k == 0 and self.short[n] for n, _, k in self.items], bool)
        self.by_size: dict[int, tuple[np.ndarray, ...]] = {}
        for size, found in own.items():
            h, p, off, last = (np.array(x, t) for x, t in zip(found, (np.uint64, np.int64, np.int64, np.uint64)))
            order = np.lexsort((p, h))
            bits = np.zeros(1 << _BITS, bool)
            bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.by_size[size] = bits, h[order], p[order], off[order], last[order]

    def hits(self, codes: np.ndarray, starts: np.ndarray):
        """(text, position, piece) wherever the hashes of a piece's first and last
        characters stand in the codes; of a short item the first in each text."""
        hashes = rolling(codes, max(self.by_size, default=1))
        # whether a blank or a text's end stands before, and at, each position
        before, at_end = (np.concatenate(([True], codes <= 32)), np.concatenate((codes <= 32, [True]))) if self.words_at.any() else (None, None)
        for size, (bits, h, own, off, last) in self.by_size.items():
            x = hashes[size]
            at = np.flatnonzero(bits[(x >> np.uint64(64 - _BITS)).astype(np.int64)])
            low, high = np.searchsorted(h, x[at]), np.searchsorted(h, x[at], side="right")
            n = high - low
            at, entry = np.repeat(at, n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            end = at + off[entry]
            fits = end < len(x)
            fits[fits] = x[end[fits]] == last[entry[fits]]
            if before is not None:
                must = self.words_at[own[entry[fits]]]
                fits[fits] = (before[at[fits]] | (must & 1 == 0)) & (at_end[end[fits] + size] | (must & 2 == 0))
            at, piece = at[fits], own[entry[fits]]
            text = np.searchsorted(starts, at, side="right") - 1
            once = self.once[self.segment[piece]]
            if once.any():  # their two hashes cover them whole
                first = np.zeros(len(at), bool)
                first[np.unique(text[once] * len(self.segment) + piece[once], return_index=True)[1]] = True
                keep = ~once
                keep[once] = first[:int(once.sum())]
                at, piece, text = at[keep], piece[keep], text[keep]
            yield from zip(text.tolist(), at.tolist(), piece.tolist())

    def matches(self, texts: list[str], known: dict) -> list[tuple[int, int, int]]:
        """(text, segment, distance) of the segments within their budget."""
        joined = "\x00".join(texts)
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        best: dict[tuple[int, int], int] = {}
        checked: set = set()
        for t, pos, p in self.hits(np.frombuffer(joined.encode("utf-32-le"), np.uint32), starts):
            i, (a, b) = int(self.segment[p]), self.bounds[p].tolist()
            _, item, k = self.items[i]
            if not joined.startswith(item[a:b], pos) or best.get((t, i)) == 0:
                continue
            begin, end = max(int(starts[t]), pos - a - k), min(int(starts[t + 1]) - 1, pos - a + len(item) + k)
            if (t, i, begin, end) in checked:
                continue
            checked.add((t, i, begin, end))
            window = joined[begin:end]
            d = known.get((i, window))
            if d is None:
                if len(known) > 50_000:
                    known.clear()
                d = known[i, window] = 0 if item in window else myers(item, window, k)
            if d <= k and d < best.get((t, i), k + 1):
                best[t, i] = d
        return [(t, i, d) for (t, i), d in best.items()]

    def leaks(self, texts: list[str], known: dict) -> dict[tuple[int, int], tuple[int, int]]:
        """{(text, item): (least distance, least -budget of the segments at it)}, texts
        of any length."""
        own, cut = [], []
        for t, text in enumerate(texts):
            parts = windows(text)
            cut += parts
            own += [t] * len(parts)
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for i, j in chunks_by_chars(cut, WINDOW):
            for w, s, d in self.matches(cut[i:j], known):
                number, _, k = self.items[s]
                key = own[i + w], number
                out[key] = min(out.get(key, (d, -k)), (d, -k))
        return out


def _scan(batches, index):
    x = index.value
    known: dict = {}  # verified windows; copies of a text repeat them
    for batch in batches:
        found = x.leaks([normalise(t) for t in batch.column("text").to_pylist()], known)
        rows = pa.array([t for t, _ in found], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(rows), pa.array([x.ids[n] for _, n in found], pa.int64()), pa.array([d for d, _ in found.values()], pa.int64()),
             pa.array([-k for _, k in found.values()], pa.int64()), pa.array(["short" if x.short[n] else "edit" for _, n in found], pa.string())],
            names=["doc_id", "item_id", "distance", "budget", "kind"])


def _items(items: DataFrame, item_id_col: str, item_text_col: str) -> DataFrame:
    return (items.select(F.col(quoted(item_id_col)).cast("bigint").alias("item_id"), F.col(quoted(item_text_col)).alias("text"))
            .where(F.col("text").isNotNull()).distinct())


def _blocks(items: DataFrame, rate: float, min_words: int):
    """Broadcast indexes of the items, block after block of bounded size. All
    texts of an id are in one block; those without id are dealt by their text."""
    spark = items.sparkSession
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_CHARS))
    deal = F.pmod(F.coalesce(F.xxhash64(F.lit(0), F.when(F.col("item_id").isNotNull(), F.col("item_id").cast("string")).otherwise(F.col("text")))), F.lit(blocks))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(deal == b)
        yield spark.sparkContext.broadcast(Index(((r["item_id"], r["text"]) for r in part.toLocalIterator()), rate, min_words))


def contaminations(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                   rate: float = 0.06, min_words: int = 5) -> DataFrame:
    """One row per row of ``docs`` and item within its budget: doc_id, item_id,
    distance (least over the item's segments), budget, kind."""
    prepare(docs.sparkSession)
    base = docs.select(F.col(quoted(id_col)).cast("bigint").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    out = None
    for index in _blocks(_items(items, item_id_col, item_text_col), rate, min_words):
        part = base.mapInArrow(partial(_scan, index=index), "doc_id bigint, item_id bigint, distance bigint, budget bigint, kind string")
        out = part if out is None else out.union(part)
    return out


def _clean(batches, index):
    x = index.value
    known: dict = {}
    whole = {s for n, s, _ in x.items if x.short[n]}
    for batch in batches:
        texts = [normalise(t) for t in batch.column("text").to_pylist()]
        gone = {t for t, n in x.leaks(texts, known) if not x.short[n]} | {t for t, text in enumerate(texts) if text in whole}
        yield batch.filter(pa.array([t not in gone for t in range(len(texts))], pa.bool_()))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", rate: float = 0.06, min_words: int = 5) -> DataFrame:
    """``docs`` without its contaminated rows; all columns as they are."""
    prepare(docs.sparkSession)
    base = docs.select(row_of(docs, text_col), F.col(quoted(text_col)).alias("text"))
    out = base
    for index in _blocks(_items(items, item_id_col, item_text_col), rate, min_words):
        out = out.mapInArrow(partial(_clean, index=index), base.schema)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
