"""Manifests read by blocks: one large JSON file is shared out among tasks.

The files are scanned as text records that end at ``}``, so Spark splits them
like any text file, on any file system it reads. A manifest that was written in
parts, with whole entries on each line, is scanned by lines. A block can't know
whether it begins inside a string, or how deep; so

  1. each block is summed up for both cases (in a string or not): whether it
     ends in one, how much deeper, and the last keys on the way;
  2. the summaries of a manifest, one small row a block, are chained into the
     state each block begins with;
  3. with it each block gives the entries of the sections asked for, an entry
     cut by block ends as fragments, which are put together by its position.

The signs of a whole batch of records are found at once; a task holds one batch
and one entry at a time, however large the file is. Sections other than those
asked for are passed over without being parsed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import file_path, materialize

SECTIONS = ("metadata", "nodes", "sources")
_OUT_ROWS = 2000
#: Bytes of records whose signs are found at once.
_AT_ONCE = 1 << 20
_QUOTE, _OBJECT, _LIST, _CLOSE, _COMMA = 1, 2, 3, 4, 5
_KINDS = np.zeros(256, np.uint8)
for _sign, _kind in zip(b'"{[}],', (_QUOTE, _OBJECT, _LIST, _CLOSE, _CLOSE, _COMMA)):
    _KINDS[_sign] = _kind
_STEPS = np.zeros(8, np.int64)
_STEPS[[_OBJECT, _LIST, _CLOSE]] = 1, 1, -1


def _signs(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(positions, kinds) of the signs of a text: quotes that aren't escaped,
    brackets and commas, in strings too."""
    octets = np.frombuffer(text, np.uint8)
    kinds = _KINDS[octets]
    back = np.flatnonzero(octets == 92)
    if len(back):
        # of a run of backslashes the first, third, ... one escapes what follows it
        runs = np.flatnonzero(np.diff(back, prepend=-2) != 1)
        first = np.repeat(back[runs], np.diff(runs, append=len(back)))
        escaped = back[(back - first) % 2 == 0] + 1
        escaped = escaped[escaped < len(octets)]
        kinds[escaped[octets[escaped] == 34]] = 0
    at = np.flatnonzero(kinds)
    return at, kinds[at]


def _key_before(text: bytes, quotes: np.ndarray, at: int) -> str | None:
    """The string that ended last before a position outside of strings; None if it began before the text."""
    n = int(np.searchsorted(quotes, at))
    return text[quotes[n - 2] + 1:quotes[n - 1]].decode("utf-8", "replace") if n >= 2 else None


class _Walk:
    """How deep a stretch of JSON gets, from a state that is given or supposed."""

    def __init__(self, in_string: bool, depth: int = 0):
        self.in_string, self.depth = in_string, depth
        self.keys: dict[int, str | None] = {}  # the key whose object opened last at a depth

    def pass_over(self, text: bytes, at: np.ndarray, kinds: np.ndarray) -> None:
        """Depth, and the keys of objects opened at a depth of one or less."""
        quote = kinds == _QUOTE
        quotes = at[quote]
        # how many quotes came before, odd or even: the small number may wrap
        inside = (np.cumsum(quote, dtype=np.uint8) + np.uint8(self.in_string)) & 1
        told = np.flatnonzero((inside == 0) & ~quote)
        at, kinds = at[told], kinds[told]
        steps = _STEPS[kinds]
        depth = self.depth + np.cumsum(steps)
        opened = np.flatnonzero((steps == 1) & (depth <= 2))[::-1]
        _, last = np.unique(depth[opened], return_index=True)
        for i in opened[last]:
            self.keys[int(depth[i]) - 1] = _key_before(text, quotes, at[i]) if kinds[i] == _OBJECT else None
        if len(at):
            self.depth = int(depth[-1])
        if len(inside):
            self.in_string = bool(inside[-1])


def _blocks(batches, key: list[str], end: bytes) -> Iterator[tuple[tuple, bytes, dict]]:
    """Runs of records of one block: (its key, their text, the other columns' first values)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column("value").to_pylist()
        new = np.zeros(len(values), bool)
        for c in map(batch.column, key):
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        starts = [0, *np.flatnonzero(new).tolist(), len(values)]
        for i, j in zip(starts, starts[1:]):
            first = {n: batch.column(n)[i].as_py() for n in batch.schema.names if n != "value"}
            while i < j:
                upto, size = i, 0
                while upto < j and size < _AT_ONCE:
                    size += len(values[upto])
                    upto += 1
                yield tuple(first[k] for k in key), end.join(values[i:upto]) + end, first
                i = upto


def _summaries(batches, end, in_parts=False):
    """Per block: how it ends and how deep it gets, out of and in a string; blocks
    of parts begin between entries, so out of one."""
    now, walks = None, ()

    def row():
        out = {"file": [now[0]], "block": [now[1]]}
        for name, w in zip(("out", "in"), walks):
            out |= {f"{name}_string": [w.in_string], f"{name}_depth": [w.depth], f"{name}_at": [list(w.keys)], f"{name}_keys": [list(w.keys.values())]}
        return pa.RecordBatch.from_pydict(out, schema=_SUMMARY)
    for key, text, _ in _blocks(batches, ["file", "block"], end):
        if key != now:
            if now is not None:
                yield row()
            now, walks = key, (_Walk(False), _Walk(not in_parts))
        at, kinds = _signs(text)
        at, kinds = at[kinds != _COMMA], kinds[kinds != _COMMA]
        for w in walks[:1] if in_parts else walks:
            w.pass_over(text, at, kinds)
    if now is not None:
        yield row()


_BOTH = (("string", pa.bool_(), "boolean"), ("depth", pa.int64(), "bigint"), ("at", pa.list_(pa.int64()), "array<bigint>"), ("keys", pa.list_(pa.string()), "array<string>"))
_SUMMARY = pa.schema([("file", pa.string()), ("block", pa.int64()), *[(f"{x}_{n}", t) for x in ("out", "in") for n, t, _ in _BOTH]])
_SUMMARY_DDL = "file string, block bigint, " + ", ".join(f"{x}_{n} {t}" for x in ("out", "in") for n, _, t in _BOTH)
_STATE = pa.schema([("project", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("nth", pa.int64()), ("in_string", pa.bool_()), ("depth", pa.int64()), ("section", pa.string())])
_STATE_DDL = "project string, file string, block bigint, nth bigint, in_string boolean, depth bigint, section string"


def _chain(table: pa.Table) -> pa.Table:
    """The state each block of one manifest begins with, the blocks numbered."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["file"], r["block"]))
    out, in_string, depth, keys = [], False, 0, {}
    for nth, r in enumerate(rows):
        out.append({"project": r["project"], "file": r["file"], "block": r["block"], "nth": nth, "in_string": in_string, "depth": depth, "section": keys.get(1) if depth >= 2 else None})
        side = "in" if in_string else "out"
        for at, key in zip(r[f"{side}_at"], r[f"{side}_keys"]):
            keys[depth + at] = key
        depth, in_string = depth + r[f"{side}_depth"], r[f"{side}_string"]
    return pa.Table.from_pylist(out, _STATE)


_FRAGMENT = pa.schema([("id", pa.int64()), ("section", pa.string()), ("idx", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])
_FRAGMENT_DDL = "id bigint, section string, idx bigint, whole boolean, text string"


class _Entries:
    """Cuts a block into the entries (``"key": value``) of some sections."""

    def __init__(self, in_string, depth, section, sections):
        self.in_string, self.depth = in_string, depth
        self.section, self.sections = section, sections
        #: pieces of the entry that is open; one from an earlier block has index -1
        self.pieces: list[bytes] | None = [] if depth >= 2 and section in sections and (depth > 2 or in_string) else None
        self.idx, self.begun, self.count = -1, False, dict.fromkeys(sections, 0)

    def entry(self, whole: bool):
        text = b"".join(self.pieces).decode("utf-8", "replace")
        out = (self.section, self.idx, whole and self.begun, text)
        self.pieces = None
        return out

    def cut(self, text: bytes):
        """The entries that end in this text."""
        at, kinds = _signs(text)
        quote = kinds == _QUOTE
        quotes = at[quote]
        inside = ((np.cumsum(quote, dtype=np.uint8) + np.uint8(self.in_string)) & 1).astype(bool)
        end_inside = bool(inside[-1]) if len(at) else self.in_string
        # strings that begin, and signs out of strings
        some = np.flatnonzero(inside == quote)
        at, kinds, quote = at[some], kinds[some], quote[some]
        depth = self.depth + np.cumsum(_STEPS[kinds])
        # strings that begin and commas between entries; sections that open; values and sections that end
        told = np.flatnonzero(np.where(quote | (kinds == _COMMA), depth == 2, depth <= 2))
        start = 0  # of the open entry's text
        for i, kind, deep in zip(at[told].tolist(), kinds[told].tolist(), depth[told].tolist()):
            if kind == _QUOTE:
                if self.pieces is None and self.section in self.sections:
                    self.pieces, start, self.begun = [], i, True
                    self.idx = self.count[self.section]
                    self.count[self.section] += 1
            elif kind == _COMMA:
                if self.pieces is not None:  # after a plain value
                    self.pieces.append(text[start:i])
                    yield self.entry(True)
            elif kind == _CLOSE:
                if self.pieces is not None:
                    # the end of the entry's own value, or of its section after a plain value
                    self.pieces.append(text[start:i + 1 if deep == 2 else i])
                    yield self.entry(True)
                if deep < 2:
                    self.section = None
            elif deep == 2:
                self.section = _key_before(text, quotes, i) if kind == _OBJECT else None
        if self.pieces is not None:
            self.pieces.append(text[start:])
        if len(at):
            self.depth = int(depth[-1])
        self.in_string = end_inside


def _fragments(batches, sections, end):
    """Rows of whole entries and fragments, in blocks that know their state."""
    now, walk, held = None, None, []

    def flush():
        cols = list(zip(*held))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FRAGMENT)], schema=_FRAGMENT)
    for key, text, state in _blocks(batches, ["id"], end):
        if key != now:
            if walk is not None and walk.pieces:
                held.append((*now, *walk.entry(False)))
            now, walk = key, _Entries(state["in_string"], state["depth"], state["section"], sections)
        for e in walk.cut(text):
            held.append((*now, *e))
            if len(held) >= _OUT_ROWS:
                yield flush()
    if walk is not None and walk.pieces:
        held.append((*now, *walk.entry(False)))
    if held:
        yield flush()


def scan_entries(spark: SparkSession, paths: str | list[str], sections: tuple[str, ...] = SECTIONS, in_parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(states, fragments): a small row for each block, written, and the rows of
    entries and fragments, not computed yet. Two scans of the files in all."""
    end = "\n" if in_parts else "}"
    name = file_path("file")
    project = F.regexp_replace(name, "/[^/]*$", "") if in_parts else name
    raw = (spark.read.option("lineSep", end).text(paths)
           .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")))
    summaries = raw.mapInArrow(lambda it: _summaries(it, end.encode(), in_parts), _SUMMARY_DDL)
    states = materialize(summaries.select(project.alias("project"), "*").groupBy("project").applyInArrow(_chain, _STATE_DDL)
                         .withColumn("id", F.monotonically_increasing_id()), "manifest-blocks")
    # a row of some bytes for each block, of which the scan's own plan holds the list
    known = raw.join(F.broadcast(states), ["file", "block"]).select("id", "in_string", "depth", "section", "value")
    return states, known.mapInArrow(lambda it: _fragments(it, sections, end.encode()), _FRAGMENT_DDL)


def places(parts: DataFrame, states: DataFrame) -> DataFrame:
    """``(id, section, project, nth, base)``: the position in its manifest at which
    the entries of each block begin; some rows a block, written."""
    begun = parts.groupBy("id", "section").agg(F.count_if(F.col("idx") >= 0).alias("n")).join(states.select("id", "project", "nth"), "id")
    before = F.sum("n").over(Window.partitionBy("project", "section").orderBy("nth")) - F.col("n")
    return materialize(begun.select("id", "section", "project", "nth", before.alias("base")), "manifest-places")


def placed(parts: DataFrame, at: DataFrame) -> DataFrame:
    """Written rows of entries and fragments with their project and position."""
    return parts.join(F.broadcast(at), ["id", "section"]).withColumn("pos", F.col("base") + F.col("idx"))


def put_together(parts: DataFrame, at: DataFrame) -> DataFrame:
    """``(project, section, pos, text)`` of the entries that block ends cut."""
    return (placed(parts.where("not whole"), at).groupBy("project", "section", "pos").agg(F.sort_array(F.collect_list(F.struct("nth", "text"))).alias("p"))
            .select("project", "section", "pos", F.array_join("p.text", "").alias("text")))


def read_entries(spark: SparkSession, paths: str | list[str], sections: tuple[str, ...] = SECTIONS, in_parts: bool = False) -> DataFrame:
    """``(project, section, pos, text)``: the entries of each manifest's top-level
    objects ``sections``, as JSON text ``"key": value``, with their position.

    A manifest is a file, named by its path; ``in_parts``: the files of a folder
    in the order of their names, whose lines end between entries, named by the
    folder's path. Two scans of the files; the entries are written once in the
    shared folder."""
    states, fragments = scan_entries(spark, paths, sections, in_parts)
    parts = materialize(fragments, "manifest-entries", large=True)
    at = places(parts, states)
    return placed(parts.where("whole"), at).select("project", "section", "pos", "text").unionByName(put_together(parts, at))
