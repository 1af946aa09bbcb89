"""Line dedup: sharded minimal perfect hashes over distinct line digests index
fingerprint, count and last-holder arrays; documents probe the arrays.

A line's key is the line without the white space ``[\\x20\\x09-\\x0D]`` at both
ends, with A-Z lower-cased. A key of at least ``min_chars`` code points found
in at least ``min_docs`` documents is repeated: its lines go from all
documents but the largest doc_id holding it.

How it runs
  1. One pass over the texts gives each document's distinct 128-bit line
     digests; they are counted per digest (partial counts before the shuffle).
  2. All distinct digests are dealt to shards by digest; each shard becomes one
     row of arrays (``mph.HashArrays``). No text line is stored. A probe reads
     a digest's count, and with it whether the line is repeated.
  3. Very frequent digests, at most ``HEAVY`` by construction (each holds
     1/HEAVY of all holdings), form one more index that is broadcast. All other
     lines are probed where their shard's arrays are, as digests of 16 bytes:
     arrays and probes are sorted to one place and streamed, so a task holds one
     shard's arrays and one batch of probes. Without the frequent digests no
     shard has more than its share.
  4. The line numbers to drop (few) join their documents.

Defined results
  null text: like the empty text, one empty line, nothing dropped, text ''.
  null doc_id: the document holds no key (it neither counts nor keeps), and
    repeated lines go from it.
  a doc_id on several rows: counts as one holder; each row is treated alike.
  a key several times in its last holder: all those lines stay.
  empty table: empty result. Input columns named like an output are replaced.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabledocs.llm.common import prepare, quoted, row_of, text_key, with_columns, written
from tabledocs.llm.mph import HashArrays

BLANK = " \t\n\x0b\x0c\r"
#: Keys that may be broadcast, 24 bytes each.
HEAVY = 4096
#: Mean keys of a shard, 24 bytes each.
SHARD_KEYS = 32_768
MIN_SHARDS = 64

_ARRAYS = "shard int, kind int, a bigint, b bigint, k1 bigint, k2 bigint, doc bigint, line int, " \
          "sizes array<int>, bits binary, fp binary, counts binary, last binary"


def line_digests(text: str | None, min_chars: int) -> list[bytes | None]:
    """The 128-bit digest of each line's key; None for keys that are too short."""
    out: list[bytes | None] = []
    for line in (text or "").split("\n"):
        key = line.strip(BLANK)
        out.append(xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None)
    return out


def _pairs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(x[:, 0]), np.ascontiguousarray(x[:, 1])


def _holdings(batches, min_chars: int):
    """(doc, a, b) for each distinct long line of each document."""
    for batch in batches:
        row, digests = [], []
        for i, t in enumerate(batch.column("text").to_pylist()):
            own = {d for d in line_digests(t, min_chars) if d}
            row += [i] * len(own)
            digests += own
        a, b = _pairs(digests)
        yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(row, pa.int64())), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["doc", "a", "b"])


def _build(table: pa.Table) -> pa.Table:
    """One shard's keys to one row of arrays."""
    col = lambda n: table.column(n).to_numpy()
    x = HashArrays.build(col("a").view(np.uint64), col("b").view(np.uint64), col("n"), col("last")).dump()
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "sizes": pa.array([x["sizes"]], pa.list_(pa.int32())),
                     **{k: pa.array([x[k]], pa.binary()) for k in ("bits", "fp", "counts", "last")}})


def _to_probe(batches, min_chars: int, shards: int, heavy):
    """A probe for each long line that the broadcast index doesn't decide."""
    index = HashArrays.load(**heavy.value)
    for batch in batches:
        row, line, digests = [], [], []
        for i, t in enumerate(batch.column("text").to_pylist()):
            for j, d in enumerate(line_digests(t, min_chars)):
                if d:
                    row.append(i)
                    line.append(j)
                    digests.append(d)
        a, b = _pairs(digests)
        left = ~index.probe(a, b)[0]
        at = pa.array(np.flatnonzero(left))
        rows = pa.array(row, pa.int64()).take(at)
        yield pa.RecordBatch.from_arrays(
            [pa.array((a[left].view(np.int64) % shards).astype(np.int32)), pa.array(a[left].view(np.int64)), pa.array(b[left].view(np.int64)),
             *(batch.column(n).take(rows) for n in ("k1", "k2", "doc")), pa.array(line, pa.int32()).take(at)],
            names=["shard", "a", "b", "k1", "k2", "doc", "line"])


def _probe(batches, min_docs: int):
    """Rows sorted by shard, each shard's arrays before its probes. Gives the
    lines to drop."""
    shard, index = None, None
    for batch in batches:
        shards, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards) != 0) + 1).tolist(), len(shards)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if i == j:
                continue
            if shards[i] != shard:
                shard, index = shards[i], None
            if kind[i] == 0:
                at = {n: batch.column(n)[i].as_py() for n in ("sizes", "bits", "fp", "counts", "last")}
                index = HashArrays.load(**at)
                i += 1
            if index is None or i == j:
                continue
            part = batch.slice(i, j - i)
            found, count, last = index.probe(part.column("a").to_numpy().view(np.uint64), part.column("b").to_numpy().view(np.uint64))
            doc = part.column("doc")
            own = doc.fill_null(0).to_numpy() == last
            drop = found & (count >= min_docs) & ~(own & doc.is_valid().to_numpy(zero_copy_only=False))
            yield part.select(["k1", "k2", "line"]).filter(pa.array(drop))


def _apply(batches, min_chars: int, min_docs: int, heavy):
    """The kept lines of each document."""
    index = HashArrays.load(**heavy.value)
    for batch in batches:
        kept, total, dropped = [], [], []
        docs, lost = batch.column("doc").to_pylist(), batch.column("drop").to_pylist()
        for t, doc, drop in zip(batch.column("text").to_pylist(), docs, lost):
            lines = (t or "").split("\n")
            gone = set(drop or ())
            if len(index.fp):
                digests = line_digests(t, min_chars)
                long = [j for j, d in enumerate(digests) if d]
                found, count, last = index.probe(*_pairs([digests[j] for j in long]))
                gone.update(j for j, f, n, x in zip(long, found, count, last) if f and n >= min_docs and x != doc)
            kept.append("\n".join(x for j, x in enumerate(lines) if j not in gone) if gone else t or "")
            total.append(len(lines))
            dropped.append(len(gone))
        yield with_columns(batch, ("text", "drop", "k1", "k2", "doc"), text=pa.array(kept, pa.string()),
                           n_lines=pa.array(total, pa.int64()), n_dropped=pa.array(dropped, pa.int64()))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The rows of ``docs``: ``row`` (a struct of the input's other columns,
    the id included), ``text`` (the kept lines), ``n_lines``, ``n_dropped``."""
    spark = docs.sparkSession
    prepare(spark)
    # rows of one id and text get one result, so that pair is a document's key
    base = docs.select(F.col(quoted(id_col)).cast("bigint").alias("doc"), F.col(quoted(text_col)).alias("text"), *text_key(id_col, text_col), row_of(docs, text_col))

    held = (base.where(F.col("doc").isNotNull()).select("doc", "text")
            .mapInArrow(partial(_holdings, min_chars=min_chars), "doc bigint, a bigint, b bigint"))
    keys = written(held.groupBy("a", "b", "doc").agg(F.lit(1).alias("one"))
                   .groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc").alias("last")), "line-keys")
    n_keys, holdings = keys.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(MIN_SHARDS, math.ceil(n_keys / SHARD_KEYS))

    # at most HEAVY keys can each have more than 1/HEAVY of the holdings
    often = F.col("n") > holdings / HEAVY
    top = keys.where(often).toPandas()
    heavy = spark.sparkContext.broadcast(HashArrays.build(
        top["a"].to_numpy(np.int64).view(np.uint64), top["b"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), top["last"].to_numpy(np.int64)).dump())

    arrays = (keys.where(~often).withColumn("shard", F.pmod("a", F.lit(shards)).cast("int"))
              .groupBy("shard").applyInArrow(_build, "shard int, sizes array<int>, bits binary, fp binary, counts binary, last binary"))
    probes = base.select("doc", "text", "k1", "k2").mapInArrow(
        partial(_to_probe, min_chars=min_chars, shards=shards, heavy=heavy),
        "shard int, a bigint, b bigint, k1 bigint, k2 bigint, doc bigint, line int")
    null = lambda t: F.lit(None).cast(t)
    names = [f.split(" ")[0] for f in _ARRAYS.split(", ")]
    kinds = dict(f.split(" ") for f in _ARRAYS.split(", "))
    pad = lambda df, kind: df.withColumn("kind", F.lit(kind)).select(*[F.col(n) if n in df.columns or n == "kind" else null(kinds[n]).alias(n) for n in names])
    drops = (pad(arrays, 0).unionByName(pad(probes, 1)).repartition("shard").sortWithinPartitions("shard", "kind")
             .mapInArrow(partial(_probe, min_docs=min_docs), "k1 bigint, k2 bigint, line int")
             .groupBy("k1", "k2").agg(F.collect_set("line").alias("drop")))
    out = T.StructType([base.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return base.join(drops, ["k1", "k2"], "left").mapInArrow(partial(_apply, min_chars=min_chars, min_docs=min_docs, heavy=heavy), out)
