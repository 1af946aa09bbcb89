"""Substring dedup by hashing of lines, paragraphs and the sentences within lines.

Units of a text are its paragraphs (blocks of lines without a blank line
between), its lines and, in lines of several sentences, each sentence, so that a
passage which doesn't fill whole lines is found too. A unit is normalised
(lower-cased, runs of characters that are neither letters nor digits as one
blank) and, from ``min_chars`` normalised characters on, hashed to 128 bits.
Short units count with their neighbours: from one long sentence or line to the
next, with the short ones between, is a unit of its own (``bridge``), so that
they go with a repeated passage around them. Digests are grouped over all
documents; the earliest occurrence by (doc_id, place) stays, all others go, with
their offsets in the original text.

A unit's place is its first letter or digit. Units of the same letters and
digits that lie in each other (a line and a paragraph around it) have one place,
so they are one occurrence.

How it runs
  One pass over the texts writes a row of digest and offsets per unit, no
  text. The first occurrence per digest is a partial minimum before the
  shuffle; the join back is on the digest, after which no grouping needs a
  key's rows together, so Spark can split a frequent one.

Defined results
  null or empty text: no units. A document is known by its id and 128 bits of
  its text: rows alike in both count as one and are cut alike, rows of one id
  with other texts are documents of their own. null doc_id: each row is a
  document of its own, ranked behind all others; such rows are written once
  with a number. Units in one document repeat like those of two. Columns of
  any name and type pass. Empty table: empty result.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabledocs.llm.common import prepare, quoted, row_of, text_key, written

MIN_CHARS = 32
_APART = re.compile(r"[\W_]+")
_LETTER = re.compile(r"[^\W_]")
#: Ends of sentences: with a blank behind them, or in scripts that put none there.
_SENTENCE = re.compile(r"[.!?]+[ \t]+|[\u3002\uff01\uff1f]+[ \t]*")
_KEY = ("doc_id", "k1", "k2", "copy")


def normalise(unit: str) -> str:
    return _APART.sub(" ", unit.lower()).strip(" ")


def units(text: str | None, min_chars: int = MIN_CHARS) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normalised) of the units that count. A sentence
    includes the blanks behind it, a line or paragraph not its line break."""
    text = text or ""
    out: list[tuple[int, int, str, str]] = []
    fine: list[tuple[int, int, str]] = []  # the smallest units with a letter, in order
    block: list[tuple[int, int, str]] = []  # the lines of the paragraph
    at = 0

    def paragraph() -> None:
        if sum(bool(n) for *_, n in block) > 1:
            out.append((block[0][0], block[-1][1], "paragraph", " ".join(n for *_, n in block if n)))
        block.clear()
    for line in text.split("\n"):
        end = at + len(line)
        clean = normalise(line)
        if line.strip(" \t\r"):
            block.append((at, end, clean))
        else:
            paragraph()
        if clean:
            out.append((at, end, "line", clean))
            cuts = [0, *[m.end() for m in _SENTENCE.finditer(line) if m.end() < len(line)], len(line)]
            parts = [(at + i, at + j, n) for i, j in zip(cuts[:-1], cuts[1:]) if (n := normalise(line[i:j]))] if len(cuts) > 2 else []
            if len(parts) > 1:
                out += [(i, j, "sentence", n) for i, j, n in parts]
                fine += parts
            else:
                fine.append((at, end, clean))
        at = end + 1
    paragraph()
    long = [i for i, (*_, n) in enumerate(fine) if len(n) >= min_chars]
    out += [(fine[i][0], fine[j][1], "bridge", " ".join(n for *_, n in fine[i:j + 1])) for i, j in zip(long, long[1:]) if j > i + 1]
    return [u for u in out if len(u[3]) >= min_chars]


def _units(batches, min_chars: int):
    for batch in batches:
        row, start, end, kind, digest, place = [], [], [], [], [], []
        for i, t in enumerate(batch.column("text").to_pylist()):
            for a, b, k, clean in units(t, min_chars):
                row.append(i)
                start.append(a)
                end.append(b)
                kind.append(k)
                place.append(_LETTER.search(t, a).start())
                digest.append(xxhash.xxh3_128_digest(clean.encode("utf-8", "replace")))
        h = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
        rows = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(rows) for c in _KEY), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(place, pa.int64()), pa.array(kind, pa.string()),
             pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))],
            names=[*_KEY, "start", "end", "place", "kind", "a", "b"])


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k1, k2, copy, text and ``row`` (a struct of the other columns) of
    each row. Rows without id get a number, fixed by writing them."""
    prepare(docs.sparkSession)
    base = docs.select(F.col(quoted(id_col)).cast("bigint").alias("doc_id"), *text_key(id_col, text_col), F.col(quoted(text_col)).alias("text"), row_of(docs, text_col))
    named = base.where(F.col("doc_id").isNotNull()).withColumn("copy", F.lit(0).cast("bigint"))
    nameless = written(base.where(F.col("doc_id").isNull()).withColumn("copy", F.monotonically_increasing_id()), "nameless")
    return named.unionByName(nameless)


def repeated_units(keys: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Of ``keyed`` rows, one row per unit to remove: the document's key, kind,
    start, end (code points of the original text), and the occurrence that
    stays: first_doc_id, first_start."""
    found = written(keys.select(*_KEY, "text").mapInArrow(
        partial(_units, min_chars=min_chars), "doc_id bigint, k1 bigint, k2 bigint, copy bigint, start bigint, end bigint, place bigint, kind string, a bigint, b bigint"), "units")
    place = F.struct(F.col("doc_id").isNull().alias("n"), *_KEY, "place")
    first = (found.groupBy("a", "b").agg(F.min(F.struct(place.alias("p"), "start")).alias("first"), F.max(place).alias("last"))
             .where(~F.col("first.p").eqNullSafe(F.col("last"))).select("a", "b", "first"))
    out = found.join(first, ["a", "b"]).where(~place.eqNullSafe(F.col("first.p"))).dropDuplicates([*_KEY, "kind", "start", "end"])
    return out.select(*_KEY, "kind", "start", "end", F.col("first.p.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"))


def _cut(batches):
    for batch in batches:
        out = []
        for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            if t is not None and spans:
                keep, at = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
                    keep.append(t[at:max(at, s["start"])])
                    at = max(at, s["end"])
                t = "".join([*keep, t[at:]])
            out.append(t)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string()), batch.column("spans")], names=["row", "text", "spans"])


def remove_units(keys: DataFrame, removed: DataFrame) -> DataFrame:
    """Per ``keyed`` row: ``row``, ``text`` without the ``removed`` units, and
    ``spans``, their original offsets (null where nothing goes)."""
    spans = removed.groupBy(*[F.col(c).alias(f"of_{c}") for c in _KEY]).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    same = F.lit(True)
    for c in _KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    joined = keys.join(spans, same, "left").select("row", "text", "spans")
    return joined.mapInArrow(_cut, T.StructType([joined.schema[c] for c in ("row", "text", "spans")]))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Per row of ``docs``: ``row`` (a struct of the other columns), ``text``
    without the units that repeat, and ``spans``, their original offsets."""
    keys = keyed(docs, id_col, text_col)
    return remove_units(keys, repeated_units(keys, min_chars))


#: The rows of ``repeated_units`` over ``documents`` in DuckDB's SQL.
ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, u.i, string_split(text, chr(10)) AS ls FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)
), placed AS (
  SELECT doc_id, text, i, ls[i] AS line, CASE WHEN i = 1 THEN 0 ELSE i - 1 + list_sum([length(x) FOR x IN ls[1:i - 1]]) END::BIGINT AS off FROM lines
), parts AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13)) = '' AS blank, trim(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g')) <> '' AS worded,
    [x FOR x IN string_split(regexp_replace(line, '([.!?]+[ \t]+|[\x{3002}\x{FF01}\x{FF1F}]+[ \t]*)', '\1' || chr(57344), 'g'), chr(57344)) IF x <> ''] AS ps
  FROM placed
), cut AS (
  SELECT doc_id, text, i, off, line, u.j, off + CASE WHEN u.j = 1 THEN 0 ELSE list_sum([length(x) FOR x IN ps[1:u.j - 1]]) END::BIGINT AS s, ps[u.j] AS unit
  FROM parts, unnest(range(1, len(ps) + 1)) AS u(j) WHERE worded
), sentences AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, i) AS several FROM cut WHERE trim(regexp_replace(lower(unit), '[^\p{L}\p{N}]+', ' ', 'g')) <> ''
), fine AS (
  SELECT DISTINCT doc_id, text, i, CASE WHEN several > 1 THEN j ELSE 0 END AS j, CASE WHEN several > 1 THEN s ELSE off END AS s, CASE WHEN several > 1 THEN unit ELSE line END AS unit FROM sentences
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS idx FROM fine
), long_ones AS (
  SELECT *, lead(idx) OVER w AS next_idx, lead(s + length(unit)) OVER w AS next_end FROM ordered
  WHERE length(trim(regexp_replace(lower(unit), '[^\p{L}\p{N}]+', ' ', 'g'))) >= 32 WINDOW w AS (PARTITION BY doc_id ORDER BY idx)
), blocks AS (
  SELECT doc_id, text, min(off) AS s, max(off + length(line)) AS e FROM
    (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM parts) WHERE NOT blank GROUP BY doc_id, text, g HAVING count(*) FILTER (worded) > 1
), units AS (
  SELECT doc_id, 'line' AS kind, off AS s, line AS unit FROM parts
  UNION ALL SELECT doc_id, 'sentence', s, unit FROM sentences WHERE several > 1
  UNION ALL SELECT doc_id, 'paragraph', s, substring(text, (s + 1)::BIGINT, (e - s)::BIGINT) FROM blocks
  UNION ALL SELECT doc_id, 'bridge', s, substring(text, (s + 1)::BIGINT, (next_end - s)::BIGINT) FROM long_ones WHERE next_idx > idx + 1
), clean AS (
  SELECT doc_id, kind, s, length(unit) AS n, trim(regexp_replace(lower(unit), '[^\p{L}\p{N}]+', ' ', 'g')) AS k, s + length(regexp_extract(unit, '^[^\p{L}\p{N}]*')) AS place FROM units
), counted AS (
  SELECT * FROM clean WHERE length(k) >= 32
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS fd, first_value(s) OVER w AS fs, first_value(place) OVER w AS fp FROM counted WINDOW w AS (PARTITION BY k ORDER BY doc_id NULLS LAST, place, s)
)
SELECT doc_id, kind, s AS start, s + n AS "end", fd AS first_doc_id, fs AS first_start FROM ranked WHERE NOT (doc_id = fd AND place = fp)
"""
