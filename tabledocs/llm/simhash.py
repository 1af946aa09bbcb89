"""SimHash near-dedup with pivot distance tables.

A fingerprint has a bit set where over half of the text's shingle hashes have
it. Fingerprints link at ``max_bits`` or fewer differing bits; a component is
what links connect.

How it runs
  1. One pass over the texts gives 8-byte fingerprints; equal ones are one node
     (partial minimum before the shuffle).
  2. Nodes are dealt to cells. The 64 bits are cut into ``max_bits + 3`` blocks;
     two fingerprints that link agree on three whole blocks at least, so a cell
     is a choice of three blocks and their bits (31 to 33 of them). Cells of
     one node go. A cell of more than ``CELL`` nodes is split again: its
     other bits are cut into ``max_bits + 1`` blocks, of which two linked
     fingerprints share one, and so on while a cell is larger. So a group of
     near copies of any size falls into groups of at most ``CELL`` nodes, each
     node in a few of them, and no pairs of groups are made.
  3. In a group, the pivot table holds the Hamming distances of each node to
     ``PIVOTS`` reference fingerprints. By the triangle inequality two nodes
     whose distances to any pivot differ by more than ``max_bits`` can't link:
     pairs are discarded by their largest coordinate difference, and the
     survivors verified with the exact distance. (In groups of up to ``FEW``
     nodes the exact distance costs less than the table.) A group gives a
     spanning forest of its links, never all pairs.
  4. Components of the forests' edges (``components.py``).

Defined results
  null, empty or blank text: fingerprint zero, linked like any other.
  fewer words than a shingle: the whole word sequence is the one shingle.
  null doc_id: gets its component's id; counts for it only as a link.
    A component of null doc_ids only has the id null.
  repeated rows: one fingerprint, one component. Empty table: empty result.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabledocs.llm.common import mix64, prepare, quoted, written
from tabledocs.llm.components import components

SEED = 42
#: Reference fingerprints: fixed 64-bit numbers made by a mixing rule.
PIVOTS = mix64(np.arange(1, 25, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Most nodes of a cell.
CELL = 2048
#: Nodes of a group up to which pairs go without the pivot table.
FEW = 16


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of the lower-cased word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII blanks
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[i:j], SEED) for i, j in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())), np.uint64, len(words) - shingle + 1)


def fingerprint(text: str | None, shingle: int) -> int:
    h = shingle_hashes(text, shingle)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        part = h[i:i + 8192]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(batches, shingle: int):
    for batch in batches:
        fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(fps.view(np.int64))], names=["row", "fp"])


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def cell_masks(max_bits: int) -> list[int]:
    """Masks of every three of ``max_bits + 3`` blocks, as signed 64-bit numbers."""
    n = max_bits + 3
    cuts = [round(64 * i / n) for i in range(n + 1)]
    blocks = [((1 << (j - i)) - 1) << i for i, j in zip(cuts[:-1], cuts[1:])]
    return [_signed(sum(c)) for c in combinations(blocks, 3)]


def finer_masks(mask: int, max_bits: int) -> list[int]:
    """The mask with each of ``max_bits + 1`` blocks of its other bits."""
    full = mask & (1 << 64) - 1
    rest = [i for i in range(64) if not full >> i & 1]
    cuts = [round(len(rest) * i / (max_bits + 1)) for i in range(max_bits + 2)]
    return sorted({_signed(full | sum(1 << b for b in rest[i:j])) for i, j in zip(cuts[:-1], cuts[1:])})


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the labels of linked positions: labels are least positions."""
    while len(i):
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(up := label[label], label):
            label[:] = up
        left = label[i] != label[j]
        i, j = i[left], j[left]


def link_groups(group: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``group``: sorted group numbers of the nodes ``fp``. Returns a spanning
    forest of the links inside each group, as node pairs."""
    n = len(fp)
    end = np.searchsorted(group, group, side="right")
    large = np.flatnonzero(end - np.searchsorted(group, group) > FEW)
    row = np.full(n, -1)  # in the pivot distance table
    row[large] = np.arange(len(large))
    table = np.bitwise_count(fp[large][:, None] ^ PIVOTS[None, :]).astype(np.int8)
    label = np.arange(n)
    alive = np.arange(n)
    step = 0
    while True:
        step += 1
        alive = alive[end[alive] > alive + step]
        if not len(alive):
            break
        for k in range(0, len(alive), 200_000):
            i = alive[k:k + 200_000]
            j = i + step
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
            for p in range(table.shape[1]):
                if not (row[i] >= 0).any():
                    break
                near = (row[i] < 0) | (np.abs(table[row[i], p] - table[row[j], p]) <= max_bits)
                i, j = i[near], j[near]
            linked = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
            _join(label, i[linked], j[linked])
    out = np.flatnonzero(label != np.arange(n))
    return fp[out], fp[label[out]]


def _link(batches, max_bits: int):
    """Rows sorted by group; a group may span batches."""
    names = ["mask", "key"]
    rest: list[np.ndarray] = []
    for batch in batches:
        now = [batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (*names, "fp")]
        rest = [np.concatenate(x) for x in zip(rest, now)] if rest else now
        same = np.ones(len(rest[0]), bool)
        for x in rest[:-1]:
            same &= x == x[-1]
        first = int(np.argmax(same))  # the last group may go on in the next batch
        if first >= 20_000:
            yield _forest([x[:first] for x in rest], max_bits)
            rest = [x[first:] for x in rest]
    if rest:
        yield _forest(rest, max_bits)


def _forest(cols: list[np.ndarray], max_bits: int) -> pa.RecordBatch:
    new = np.zeros(len(cols[0]), bool)
    for x in cols[:-1]:
        new[1:] |= x[1:] != x[:-1]
    u, v = link_groups(np.cumsum(new), cols[-1].view(np.uint64), max_bits)
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def near_links(nodes: DataFrame, max_bits: int) -> DataFrame:
    """``nodes`` (fp): distinct fingerprints. Edges (u, v) that connect all
    fingerprints which links connect."""
    spark = nodes.sparkSession
    masks = cell_masks(max_bits)
    cells = nodes.select(F.col("fp"), F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    groups = None
    while True:
        sizes = written(cells.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "cells")
        small = cells.join(sizes.where(F.col("n") <= CELL), ["mask", "key"]).select("mask", "key", "fp")
        groups = small if groups is None else groups.unionByName(small)
        # the masks of hot cells: at most those of this level, a fixed number
        masks = [r["mask"] for r in sizes.where(F.col("n") > CELL).select("mask").distinct().collect()]
        if not masks:
            break
        hot = written(cells.join(sizes.where(F.col("n") > CELL), ["mask", "key"]).select("mask", "fp"), "hot-cells")
        finer = spark.createDataFrame([(m, x) for m in masks for x in finer_masks(m, max_bits)], "mask bigint, finer bigint")
        cells = (hot.join(F.broadcast(finer), "mask").select("fp", F.col("finer").alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
                 .dropDuplicates(["mask", "key", "fp"]))
    return (groups.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
            .mapInArrow(partial(_link, max_bits=max_bits), "u bigint, v bigint"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id
    (smallest doc_id reachable), ``root`` (the component's least fingerprint,
    never null) and ``row``, a struct of the id and the ``carry`` columns."""
    prepare(docs.sparkSession)
    small = docs.select(F.struct(F.col(quoted(id_col)).cast("bigint").alias("__doc"), *[F.col(quoted(c)) for c in carry]).alias("row"), F.col(quoted(text_col)).alias("text"))
    fps = written(small.mapInArrow(partial(_fingerprints, shingle=shingle), _schema(small)), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("row.__doc").alias("doc")), "nodes")
    stars = components(near_links(nodes.select("fp"), max_bits))
    rooted = nodes.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = rooted.select("fp", "root").join(ids, "root")
    return fps.join(named, "fp").select(
        F.col("row.__doc").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root", "row")


def _schema(small: DataFrame):
    from pyspark.sql import types as T
    return T.StructType([small.schema["row"], T.StructField("fp", T.LongType())])
