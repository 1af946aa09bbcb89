"""Best-fit packing with swap-based local search.

Documents become token ids and an end token; longer ones than a sequence are
cut into whole sequences, of which the first may be shorter. Pieces are packed
into as few sequences as the search finds.

How it runs
  1. One pass tokenizes the texts and writes a row per piece (no text, no ids).
  2. Whole pieces are sequences. The others are dealt evenly at random into
     shards of about ``SHARD`` pieces. A shard is packed by best fit of the
     pieces in falling length; then a local search over its underfull bins
     moves documents, or exchanges one for one or two for one, so that the sum
     of squared fills always rises, until bins empty or nothing improves.
  3. The underfull bins of all shards are opened again and dealt into fewer
     shards, until one shard is left or their number no longer falls.

Defined results
  null text: the empty text, which is the end token alone. null doc_id: packed
  like any other. Repeated rows: each is a document. Empty table: empty result.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabledocs.llm.common import prepare, written

SHARD = 20_000
#: Steps of the local search per underfull bin (2,000 in all at least).
STEPS = 8
#: Fixed value: the pre-token pattern of byte-level BPE files of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Outside ASCII, Latin letters and common punctuation.
_UNUSUAL = re.compile("[^\x00-\x7f\u00a1-\u024f\u2010-\u2027\u20ac]")

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def merges_by_rank(file: dict) -> bool:
    """Whether a tokenizer file is a byte-level BPE without a normaliser, with the
    usual pre-tokens and ids in the order of its merges, so that merging by the
    rank of ids gives its tokens."""
    model, before = file["model"], file["pre_tokenizer"] or {}
    if file["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or model["type"] != "BPE":
        return False
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    vocab = model["vocab"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [vocab.get(x, -1) for x in merged]
    made = set(merged)
    special = {t["content"] for t in file["added_tokens"]}
    base = [i for x, i in vocab.items() if x not in made and x not in special]
    return ids == sorted(set(ids)) and len(base) == 256 and max(base) < min(ids, default=1 << 62)


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, as the
    ``tokenizers`` file at ``path`` (a byte-level BPE) gives them.

    ``tiktoken`` merges by the same ranks several times faster; texts of plain
    letters go there. Texts with a special token's string, or with characters
    that two Unicode versions might class differently, go to ``tokenizers``, and
    so do all texts if the file isn't plainly of this kind (``merges_by_rank``)."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if not merges_by_rank(json.loads(self.tokenizer.to_str())):
            return
        # the printable stand-ins of a byte-level vocabulary: printable bytes
        # stand for themselves, the others for the characters from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [x for x in range(256) if x not in plain]
        byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}
        ranks = {bytes(byte[c] for c in w): i for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if w not in self.special}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if self.fast and (text.isascii() or not _UNUSUAL.search(text)) and not any(x in text for x in self.special):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces_of(ids: bytes, limit: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's id bytes, end token included."""
    n = len(ids) // 4
    cuts = [0, *range((n - 1) % limit + 1, n + 1, limit)]
    return [(k, i, j - i, zlib.crc32(ids[4 * i:4 * j])) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:]))]


def _tokenize(batches, path: str, limit: int, end: bytes):
    code = encoder(path)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        if not texts:
            continue
        rows, out = [], []
        for i, t in enumerate(texts):
            for p in pieces_of(code.encode(t) + end, limit):
                rows.append(i)
                out.append(p)
        piece, start, length, crc = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32"])


def best_fit(lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Bins (lists of positions): each piece, longest first, goes to the bin it
    leaves the least room in."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(limit + 1)]  # bins by room
    some = 0  # bit r: a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
            bins[b].append(i)
            r -= n
        else:
            b, r = len(bins), limit - n
            bins.append([i])
        room[r].append(b)
        some |= 1 << r
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, limit: int, steps: int = STEPS) -> list[list[int]]:
    """Improve underfull ``bins``: the emptiest bin gives a document away (a
    move), one for a shorter one, or two for one, always so that the sum of
    squared fills rises; emptied bins go."""
    item = np.array([i for b in bins for i in b], np.int64)
    if not len(item):
        return []
    size = lengths[item].astype(np.int64)
    where = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    fill = np.bincount(where, weights=size, minlength=len(bins)).astype(np.int64)
    stuck = fill >= limit
    left = max(2000, steps * len(bins))
    while left > 0 and not stuck.all():
        left -= 1
        b = int(np.where(stuck, limit + 1, np.where(fill == 0, limit + 1, fill)).argmin())
        if stuck[b] or fill[b] == 0:
            break
        own = np.flatnonzero(where == b)
        gap = limit - fill
        gap[(fill == 0) | (np.arange(len(bins)) == b)] = -1
        if _move(own, size, where, fill, gap, b) or _swap(own, size, where, fill, gap, b) or _swap_two(own, size, where, fill, gap, b):
            stuck = fill >= limit  # the changed bins may let others go on
            continue
        stuck[b] = True
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(len(bins) + 1))
    return [item[order[i:j]].tolist() for i, j in zip(cuts[:-1], cuts[1:]) if i < j]


def _move(own, size, where, fill, gap, b) -> bool:
    for k in own[np.argsort(-size[own], kind="stable")]:
        room = np.where(gap >= size[k], gap, np.iinfo(np.int64).max)
        a = int(room.argmin())
        if gap[a] >= size[k] and fill[a] + size[k] > fill[b]:
            where[k] = a
            fill[a] += size[k]
            fill[b] -= size[k]
            return True
    return False


def _gain(d, fa, fb):
    """Rise of the sum of squares (halved) when d goes from fill fb to fill fa."""
    return np.where(d > 0, d * (fa - fb + d), 0)


def _swap(own, size, where, fill, gap, b) -> bool:
    best, at = 0, None
    for k in own:
        d = size[k] - size
        gain = np.where(d <= gap[where], _gain(d, fill[where], fill[b]), 0)
        j = int(gain.argmax())
        if gain[j] > best:
            best, at = gain[j], (k, j)
    if at is None:
        return False
    k, j = at
    a, d = where[j], size[k] - size[j]
    where[k], where[j] = a, b
    fill[a] += d
    fill[b] -= d
    return True


def _swap_two(own, size, where, fill, gap, b) -> bool:
    best, at = 0, None
    for x in range(len(own)):
        for y in range(x + 1, len(own)):
            d = size[own[x]] + size[own[y]] - size
            gain = np.where(d <= gap[where], _gain(d, fill[where], fill[b]), 0)
            j = int(gain.argmax())
            if gain[j] > best:
                best, at = gain[j], (own[x], own[y], j)
        if at is not None:
            break
    if at is None:
        return False
    x, y, j = at
    a, d = where[j], size[x] + size[y] - size[j]
    where[x], where[y], where[j] = a, a, b
    fill[a] += d
    fill[b] -= d
    return True


def pack(lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Bins of positions for pieces of at most ``limit``."""
    bins = best_fit(lengths, limit)
    fills = [int(lengths[b].sum()) for b in bins]
    under = [b for b, f in zip(bins, fills) if f < limit]
    return [b for b, f in zip(bins, fills) if f >= limit] + local_search(under, lengths, limit)


def _packer(limit: int, first: int):
    def run(table: pa.Table) -> pa.Table:
        """A shard's pieces with sequence_id, offset and the sequence's fill."""
        lengths = table.column("length").to_numpy()
        shard = table.column("shard")[0].as_py()
        seq, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
        for k, b in enumerate(pack(lengths, limit)):
            n = lengths[b]
            seq[b] = first + (shard << 32) + k
            offset[b] = np.cumsum(n) - n
            fill[b] = n.sum()
        out = table.select(PIECES_NAMES)
        for name, x in (("sequence_id", seq), ("offset", offset), ("fill", fill)):
            out = out.append_column(name, pa.array(x))
        return out
    return run


_PACKED = PIECES + ", sequence_id bigint, offset bigint"


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, end_id: int = 0) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = written(texts.mapInArrow(partial(_tokenize, path=tokenizer_path, limit=limit, end=np.array([end_id], "<u4").tobytes()), PIECES)
                     .withColumn("at", F.monotonically_increasing_id()), "pieces")
    names = [f.split(" ")[0] for f in _PACKED.split(", ")]
    done = pieces.where(F.col("length") == limit).withColumn("sequence_id", -1 - F.col("at")).withColumn("offset", F.lit(0).cast("bigint")).select(names)
    rest = pieces.where(F.col("length") < limit).drop("at")
    before = None
    for turn in range(64):
        n = rest.count()
        shards = math.ceil(n / SHARD)
        if not n or (before is not None and n > 0.9 * before and shards > 1):
            break
        dealt = rest.withColumn("shard", F.floor(F.rand(turn) * shards).cast("bigint")) if shards > 1 else rest.withColumn("shard", F.lit(0).cast("bigint"))
        packed = written(dealt.groupBy("shard").applyInArrow(_packer(limit, turn << 56), _PACKED + ", fill bigint"), "packed")
        under = (F.col("fill") < limit) & F.lit(shards > 1)
        done = done.union(packed.where(~under).select(names))
        before, rest, last = n, packed.where(under).select(PIECES_NAMES), packed
        if shards == 1:
            return done
    else:
        raise RuntimeError("packing did not end")
    # what stays underfull and can't be packed better
    return done.union(last.where(F.col("fill") < limit).select(names)) if before is not None else done


PIECES_NAMES = [f.split(" ")[0] for f in PIECES.split(", ")]
