"""Result cache and sample cache as tables in the shared folder.

An entry is a folder of versions. A version's data is written first, then a
small pointer file of its own is renamed into place; the highest version is
current. Nothing is deleted to publish, so a reader always finds a whole
version, and of two writers the later wins. Readers leave a lease, a file with
its end of time, beside the version they read; a sweep deletes what is neither
current nor leased, expired results, and data whose writer never finished.

Values keep their Spark types (parquet), and ordered results their order. Paths
go through the Hadoop file system of the path, so local folders and cluster
storage work alike.
"""

from __future__ import annotations

import hashlib
import json
import logging
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.fixed import RESULT_CACHE_TTL_SECONDS, SQL_CACHE_HEX
from ..session import in_order, list_folder, numbered, shared_dir

log = logging.getLogger(__name__)


class _FS:
    """Small file operations through Hadoop's FileSystem (classic sessions)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _fs(self, path):
        p = self._Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def read_text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            jvm = self.spark.sparkContext._jvm
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Write a new file: it appears whole, by one rename."""
        fs, p = self._fs(path)
        tmp = self._Path(path + f".{uuid.uuid4().hex}.tmp")
        out = fs.create(tmp, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        if not fs.rename(tmp, p):
            fs.delete(tmp, False)
            raise OSError(f"could not publish {path}")

    def delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        return list_folder(self.spark, path) or []

    def age(self, path: str) -> float:
        """Seconds since a file or folder was changed."""
        fs, p = self._fs(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000


#: How long a reader may go on reading a version, and an unfinished write may last.
LEASE_SECONDS = 6 * 3600
_POINTER, _DATA, _LEASE = "v-", "data-", "lease-"


class Versions:
    """The versions of one entry in a folder."""

    def __init__(self, spark: SparkSession, root: str, lease_seconds: float = LEASE_SECONDS):
        self.spark, self.root, self.lease_seconds = spark, root.rstrip("/"), lease_seconds
        self.fs = _FS(spark)

    def versions(self) -> list[str]:
        """Published versions, the current one last."""
        return sorted(n[len(_POINTER):-5] for n in self.fs.names(self.root) if n.startswith(_POINTER) and n.endswith(".json"))

    def write(self, df: DataFrame, **meta) -> str:
        """Write a table as a new version and make it current; its name."""
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        numbered(df).write.parquet(self.data(version))
        self.fs.write_text(f"{self.root}/{_POINTER}{version}.json", json.dumps({"at": time.time(), **meta}))
        return version

    def data(self, version: str) -> str:
        return f"{self.root}/{_DATA}{version}"

    def meta(self, version: str) -> dict:
        return json.loads(self.fs.read_text(f"{self.root}/{_POINTER}{version}.json"))

    def read(self, version: str, schema: str | None = None) -> DataFrame:
        """A version's table; it stays for the time of a lease."""
        self.fs.write_text(f"{self.root}/{_LEASE}{version}-{uuid.uuid4().hex}", str(time.time() + self.lease_seconds))
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return in_order(reader.parquet(self.data(version)))

    def _over(self, version: str, expired) -> bool:
        try:
            return expired(self.meta(version))
        except Exception:  # an unreadable pointer publishes nothing
            return True

    def sweep(self, expired=lambda meta: False) -> int:
        """Delete old and expired versions that nobody reads, ended leases and
        unfinished data; how many data folders went."""
        known = self.versions()
        current = known[-1] if known else None
        leased, gone = set(), 0
        for n in self.fs.names(self.root):
            if n.startswith(_LEASE):
                try:
                    open_ = float(self.fs.read_text(f"{self.root}/{n}")) > time.time()
                except Exception:  # taken away by another sweep, or not whole
                    open_ = False
                if open_:
                    leased.add(n[len(_LEASE):].rsplit("-", 1)[0])
                else:
                    self.fs.delete(f"{self.root}/{n}")
        old = [v for v in known if v not in leased and (v != current or self._over(v, expired))]
        for v in old:  # no reader finds it from here on
            self.fs.delete(f"{self.root}/{_POINTER}{v}.json")
        kept = leased | (set(known) - set(old))
        for n in self.fs.names(self.root):
            if n.startswith(_DATA) and n[len(_DATA):] not in kept:
                # data without a pointer may be a write that is still going on
                if n[len(_DATA):] in known or self.fs.age(f"{self.root}/{n}") > self.lease_seconds:
                    self.fs.delete(f"{self.root}/{n}")
                    gone += 1
        if not self.fs.names(self.root):
            self.fs.delete(self.root)
        return gone


def cache_key(sql: str, location: str, day: str | None = None) -> str:
    """Key on the exact SQL text, the day and the data location (so the same
    text over two warehouses never shares an entry)."""
    day = day or time.strftime("%Y-%m-%d", time.gmtime())
    return hashlib.sha256(f"{sql}::{day}::{location}".encode()).hexdigest()[:SQL_CACHE_HEX]


class ResultCache:
    """Daily result cache for guarded SQL: ``get(sql)`` / ``put(sql, df)``."""

    def __init__(self, spark: SparkSession, location: str, root: str | None = None,
                 ttl_seconds: float = RESULT_CACHE_TTL_SECONDS, lease_seconds: float = LEASE_SECONDS):
        self.spark = spark
        self.location = location
        self.root = root or shared_dir(spark, "tabledocs/cache/sql")
        self.ttl, self.lease = ttl_seconds, lease_seconds

    def _entry(self, sql: str) -> Versions:
        return Versions(self.spark, f"{self.root}/{cache_key(sql, self.location)}", self.lease)

    def _expired(self, meta: dict) -> bool:
        return time.time() - float(meta["at"]) > self.ttl

    def get(self, sql: str) -> DataFrame | None:
        entry = self._entry(sql)
        for version in reversed(entry.versions()):
            try:
                if self._expired(entry.meta(version)):
                    return None
                return entry.read(version)
            except Exception as e:  # swept away, or unreadable: an older version, else a miss
                log.warning("cached result %s can't be read: %r", version, e)
        return None

    def put(self, sql: str, df: DataFrame) -> DataFrame:
        entry = self._entry(sql)
        return entry.read(entry.write(df, headers=df.columns))

    def sweep(self) -> int:
        """Delete expired results and replaced versions that nobody reads."""
        return sum(Versions(self.spark, f"{self.root}/{key}", self.lease).sweep(self._expired) for key in _FS(self.spark).names(self.root))


def write_versioned(spark: SparkSession, df: DataFrame, root: str) -> str:
    """Write a table as the new current version of ``root``; older ones that
    nobody reads go."""
    entry = Versions(spark, root)
    path = entry.data(entry.write(df))
    entry.sweep()
    return path


def read_current(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame | None:
    entry = Versions(spark, root)
    for attempt in range(5):
        known = entry.versions()
        if not known:
            return None
        try:
            return entry.read(known[-1], schema)
        except Exception:  # replaced and swept between the listing and the lease
            if attempt == 4 or entry.versions()[-1:] == known[-1:]:
                raise


def save_sample_cache(spark: SparkSession, cache_rows: DataFrame, root: str | None = None) -> str:
    """Sample cache (one row per entity, see ``samples.CACHE_SCHEMA``): the
    current table is replaced by a new version, never rewritten in place, so
    a job may read the old cache while writing the new one."""
    return write_versioned(spark, cache_rows, root or shared_dir(spark, "tabledocs/cache/samples"))


def load_sample_cache(spark: SparkSession, root: str | None = None) -> DataFrame:
    from ..operators.samples import CACHE_SCHEMA
    got = read_current(spark, root or shared_dir(spark, "tabledocs/cache/samples"), CACHE_SCHEMA)
    return got if got is not None else spark.createDataFrame([], CACHE_SCHEMA)
