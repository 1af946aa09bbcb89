"""Text files of exact names as a Spark data source: ``(path, text)`` rows.

``df.write.format("named_text").mode("append").save(folder)`` writes each row to
``<folder>/<path>``. Tasks write to a staging folder beside the files; only when
all tasks have succeeded are the files of the committed attempts moved to their
names, each by one rename. A task that is killed, repeated or run twice leaves
nothing under the names, a failed job leaves the old files. The format moves them
on the driver, ``write_files`` by tasks; ``read_files`` reads them by tasks too.

Folders may be paths or URIs of the file systems that Arrow reads (local and
mounted ones, HDFS, S3, GCS), the same on the driver and all executors. Of two
rows with one path the files replace each other: check before, where it matters.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql import types as T

from ..session import file_uri, parallelism

FORMAT = "named_text"
#: Names in one list of a task, which are moved together.
_LISTED = 4096
_LISTS = "lists.json"
#: Renames at once in a task that moves.
_MOVES = 16
#: Tasks a core, at most, that move or read files.
_TASKS = 4
#: Files that a task reads at least, and bytes in a batch of them.
_FILES, _BATCH = 256, 4 << 20
#: Files that Spark's readers unpack.
_PACKED = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst")
#: What Spark shows encoded in a file's path.
_ENCODED = r"[^!$&-;=@A-Z_a-z~\xa1-\U0010ffff]|[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def open_folder(folder: str):
    """(file system, path in it) of a folder's path or URI."""
    from pyarrow import fs
    local = re.match(r"file:/+(?!/)", folder)
    if local or "://" not in folder:
        return fs.LocalFileSystem(), "/" + folder[local.end():] if local else folder
    return fs.FileSystem.from_uri(folder)


def check_name(path: str | None) -> str:
    """The relative path, if it stays inside the folder."""
    parts = (path or "").split("/")
    if any(p in ("", ".", "..") for p in parts) or "\\" in path or "\x00" in path:
        raise ValueError(f"a document can't be a file of this name: {path!r}")
    return path


def _clear(fs, path: str) -> None:
    from pyarrow.fs import FileType
    if fs.get_file_info(path).type == FileType.Directory:
        fs.delete_dir(path)


def _move_list(fs, root: str, own: str, k: int) -> int:
    """Move the files of one list to their names; a repeated task passes over
    those that are there already."""
    from pyarrow.fs import FileType
    with fs.open_input_stream(posixpath.join(root, own, f"{k}.json")) as f:
        names = json.loads(f.read())
    for d in {posixpath.dirname(posixpath.join(root, n)) for n in names}:
        fs.create_dir(d, recursive=True)

    def move(i: int) -> None:
        staged, to = posixpath.join(root, own, f"{k}-{i}"), posixpath.join(root, names[i])
        try:
            fs.move(staged, to)
        except OSError:
            if [x.type for x in fs.get_file_info([staged, to])] != [FileType.NotFound, FileType.File]:
                raise
    with ThreadPoolExecutor(_MOVES) as pool:
        list(pool.map(move, range(len(names))))
    return len(names)


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    lists: int


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, job: str | None = None):
        self.folder = folder
        # who names the staging folder moves its files
        self.moves = job is None
        self.job = job or f".staging-{uuid.uuid4().hex}"

    def write(self, iterator):
        from pyspark import TaskContext
        task = TaskContext.get()
        own = f"{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        fs, root = open_folder(self.folder)
        fs.create_dir(posixpath.join(root, own), recursive=True)
        names, k = [], 0

        def end_list() -> None:
            with fs.open_output_stream(posixpath.join(root, own, f"{k}.json")) as out:
                out.write(json.dumps(names).encode())
        for row in iterator:
            name = check_name(row["path"])
            with fs.open_output_stream(posixpath.join(root, own, f"{k}-{len(names)}")) as out:
                out.write((row["text"] or "").encode("utf-8"))
            names.append(name)
            if len(names) == _LISTED:
                end_list()
                names, k = [], k + 1
        if names:
            end_list()
            k += 1
        return _Written(own, k)

    def commit(self, messages):
        fs, root = open_folder(self.folder)
        lists = [(m.folder, k) for m in messages if m is not None for k in range(m.lists)]
        if self.moves:
            for own, k in lists:
                _move_list(fs, root, own, k)
            _clear(fs, posixpath.join(root, self.job))
        else:
            fs.create_dir(posixpath.join(root, self.job), recursive=True)
            with fs.open_output_stream(posixpath.join(root, self.job, _LISTS)) as out:
                out.write(json.dumps(lists).encode())

    def abort(self, messages):
        fs, root = open_folder(self.folder)
        _clear(fs, posixpath.join(root, self.job))


class NamedText(DataSource):
    """The data source ``named_text``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType())])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], self.options.get("staging"))


def _move_lists(folder: str, batches):
    import pyarrow as pa
    fs, root = open_folder(folder)
    for b in batches:
        moved = [_move_list(fs, root, own, k) for own, k in zip(*(c.to_pylist() for c in b.columns))]
        yield pa.record_batch({"moved": pa.array(moved, pa.int64())})


def write_files(spark: SparkSession, rows: DataFrame, folder: str) -> None:
    """Write ``(path, text)`` rows as files of these names in ``folder``; files of
    other names stay. The driver sees the lists of names counted, not the names."""
    spark.dataSource.register(NamedText)
    job = f".staging-{uuid.uuid4().hex}"
    rows.select("path", "text").write.format(FORMAT).option("staging", job).mode("append").save(folder)
    fs, root = open_folder(folder)
    try:
        with fs.open_input_stream(posixpath.join(root, job, _LISTS)) as f:
            lists = json.loads(f.read())
        if lists:
            n = min(len(lists), _TASKS * parallelism(spark))
            (spark.createDataFrame([tuple(x) for x in lists], "own string, k int").repartition(n)
             .mapInArrow(lambda batches: _move_lists(folder, batches), "moved long").agg(F.sum("moved")).first())
    finally:
        _clear(fs, posixpath.join(root, job))


def _hidden(name: str, is_dir: bool) -> bool:
    """Whether Spark's readers pass over this name."""
    if is_dir and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _entries(root: str, nested: bool):
    """(path in the folder, whether it is a folder) of what a local folder holds
    and Spark's readers see, one at a time."""
    todo = [""]
    while todo:
        at = todo.pop()
        with os.scandir(os.path.join(root, at)) as found:
            for e in found:
                is_dir = e.is_dir()
                if not _hidden(e.name, is_dir) and (is_dir or e.is_file()):
                    yield at + e.name, is_dir
                    if is_dir and nested:
                        todo.append(f"{at}{e.name}/")


def _local(spark: SparkSession, folder: str, nested: bool, suffix: str) -> tuple[str, int] | None:
    """A local or mounted folder's path and how many files it has to read; None
    where only Spark's reader will do: other stores, patterns, single files,
    folders by partition, packed files."""
    try:
        uri = None if re.search(r"[*?\[\]{}\\]", folder) else file_uri(spark, folder)
    except Exception:  # Spark Connect, or a path that Spark's reader refuses
        return None
    root = unquote(uri[5:]) if uri and uri.startswith("file:/") else ""
    if not os.path.isdir(root):
        return None
    n = 0
    for path, is_dir in _entries(root, nested):
        if is_dir and not nested:
            return None
        if not is_dir and path.endswith(suffix):
            if path.endswith(_PACKED):
                return None
            n += 1
    return root, n


def _names(root: str, nested: bool, suffix: str, batches):
    from itertools import batched

    import pyarrow as pa
    for _ in batches:
        found = (path for path, is_dir in _entries(root, nested) if not is_dir and path.endswith(suffix))
        for some in batched(found, 10_000):
            yield pa.record_batch({"path": pa.array(some, pa.string())})


def _texts(root: str, batches):
    """Files whole, in batches bounded by bytes; empty ones give no row, as with
    Spark's reader."""
    import pyarrow as pa

    def batch():
        shown = [re.sub(_ENCODED, lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), path) for path in paths]
        return pa.record_batch({"path": pa.array(paths, pa.string()), "shown": pa.array(shown, pa.string()), "data": pa.array(data, pa.binary())})
    paths, data, size = [], [], 0
    for b in batches:
        for path in b.column(0).to_pylist():
            with open(os.path.join(root, path), "rb") as f:
                text = f.read()
            if text:
                paths.append(path)
                data.append(text)
                size += len(text)
            if size >= _BATCH:
                yield batch()
                paths, data, size = [], [], 0
    if paths:
        yield batch()


def read_files(spark: SparkSession, folder: str, nested: bool = False, suffix: str = "") -> DataFrame | None:
    """``(path, shown, text)`` of the files in a local or mounted folder, as Spark's
    whole-text reader gives them (``path`` within the folder, ``shown`` encoded as in
    its metadata); None where only that reader will do (see ``_local``). That reader's driver holds a status of
    every file and plans a task for each 32 of them; here one task lists the names,
    as a folder has one listing, and deals them out to a bounded number of tasks
    that read."""
    local = _local(spark, folder, nested, suffix)
    if local is None:
        return None
    root, n = local
    tasks = max(1, min(-(-n // _FILES), _TASKS * parallelism(spark)))
    names = spark.range(1, numPartitions=1).mapInArrow(lambda batches: _names(root, nested, suffix, batches), "path string")
    return (names.repartition(tasks, "path").mapInArrow(lambda batches: _texts(root, batches), "path string, shown string, data binary")
            .select("path", "shown", F.col("data").cast("string").alias("text")))
