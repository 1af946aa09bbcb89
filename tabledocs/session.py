"""Session set-up, table registration and the shared working folder."""

from __future__ import annotations

import os
import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

# Settings every job here relies on (safe to apply to a caller's session).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Only for sessions built here: SQL cannot reach a file path directly
# (parquet.`/path`). Guarded SQL refuses file paths in its plan check anyway.
OWN_CONF = {"spark.sql.runSQLOnFiles": "false"}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "tabledocs", extra: dict | None = None) -> SparkSession:
    """A session for tests and the bench. Clusters bring their own session and
    call :func:`configure` on it instead."""
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g"))
    for k, v in {**BASE_CONF, **OWN_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings that are safe to change on a live session,
    and make this package importable on the executors."""
    for k, v in BASE_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static or locked conf: keep the cluster's value
            pass
    try:
        ship_code(spark)
    except Exception as e:  # workers may import the package another way (PYTHONPATH)
        import logging
        logging.getLogger(__name__).warning("could not ship tabledocs to executors: %r", e)
    return spark


_SHIPPED: set = set()


def _package_zip() -> tuple[str, bytes]:
    """This package as a zip (content-addressed name)."""
    import hashlib
    import io
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in sorted(os.walk(pkg)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, base))
    data = buf.getvalue()
    return f"tabledocs-{hashlib.sha256(data).hexdigest()[:16]}.zip", data


def ship_code(spark: SparkSession) -> None:
    """Ship this package to the executors once per application, so Python
    steps that run there (Arrow batches) can import it. The zip is written to
    the shared folder and added with ``addPyFile``."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: ship as an artifact instead
        sc = None
    key = sc.applicationId if sc is not None else id(spark)
    if key in _SHIPPED:
        return
    name, data = _package_zip()
    folder = shared_dir(spark, "tabledocs/code")
    path = f"{folder}/{name}"
    if sc is None:
        local = os.path.join(tempfile.mkdtemp(prefix="tabledocs-code-"), name)
        with open(local, "wb") as fh:
            fh.write(data)
        spark.addArtifacts(local, pyfile=True)
    else:
        jvm = sc._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        fs = hpath.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(hpath):
            out = fs.create(hpath, True)
            try:
                out.write(bytearray(data))
            finally:
                out.close()
        sc.addPyFile(fs.makeQualified(hpath).toString())
    _SHIPPED.add(key)


def is_local(spark: SparkSession) -> bool:
    """Driver and executors in one process, so that they share its folders."""
    master = spark.conf.get("spark.master", "") or ""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession, sub: str = "") -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Lineage cuts and written tables go here. When the setting is unset (tests
    and local runs only) a fresh folder is made and set; on a cluster an unset
    setting is an error, because a machine-local folder is not shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="tabledocs-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    try:
        spark.sparkContext.setCheckpointDir(root)
    except Exception:  # Spark Connect has no SparkContext
        pass
    return root.rstrip("/") + ("/" + sub.strip("/") if sub else "")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def list_folder(spark: SparkSession, folder: str) -> list[str] | None:
    """Names in a folder of any file system Spark reads; None if it is missing."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    return sorted(x.getPath().getName() for x in fs.listStatus(path))


def file_uri(spark: SparkSession, path: str) -> str | None:
    """The path, qualified and encoded, on any file system Spark reads; None if nothing is there."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub(_NO_HOST, r"\1:/", fs.getFileStatus(hpath).getPath().toUri().toString()) if fs.exists(hpath) else None


# Schemes without a host are written with one slash or three.
_NO_HOST = "^([A-Za-z][A-Za-z0-9+.-]*):/{3}"


def file_path(of: str = "_metadata.file_path"):
    """Column: the file a row was read from, as ``file_uri`` gives it."""
    return F.regexp_replace(of, _NO_HOST, "$1:/")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> list[str]:
    """File-table source: one temp view per parquet table that exists."""
    there = set(list_folder(spark, sf_dir) or ())
    done = []
    for n in names:
        if f"{n}.parquet" in there:
            spark.read.parquet(table_path(sf_dir, n)).createOrReplaceTempView(n)
            done.append(n)
    return done


def parallelism(spark: SparkSession) -> int:
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # Spark Connect
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread CPU-heavy per-row work over the cluster when a scan of files
    gives fewer partitions than there are cores (a few unsplittable files).

    For a plain scan with column choices only, as read from a source: counting
    its partitions plans the scan and runs no job. A round-robin repartition is
    added only in that case; a large input already scans as many partitions
    and is left as it is (no shuffle)."""
    if df.isStreaming:
        return df
    spark = df.sparkSession
    target = min_partitions or parallelism(spark)
    try:
        n = df.rdd.getNumPartitions()
    except Exception:
        return df
    return df.repartition(target) if n < target else df


def delete_now(spark: SparkSession, path: str) -> None:
    """Delete a folder of this application's own that nothing reads any more."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder of this application's own deleted when it ends."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)


@contextmanager
def _set(spark: SparkSession, key: str, value: str):
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def shuffles_dropped(spark: SparkSession):
    """What is written meanwhile has its shuffle files deleted once it is there,
    and not when the driver's garbage is collected."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def scans_spread(spark: SparkSession):
    """What runs meanwhile scans its files by some tasks a core, as far as they can
    be split, where their reading takes long for their size."""
    return _set(spark, "spark.sql.files.minPartitionNum", str(4 * parallelism(spark)))


def shuffles_spread(spark: SparkSession, size: int):
    """What runs meanwhile starts its shuffles with a partition for each some MB of
    the ``size`` bytes it reads, if the session's number is less; adaptive execution
    joins those that turn out small."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-size // _SHUFFLED))
    return _set(spark, "spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))


#: Bytes of a packed table that make a partition of a shuffle.
_SHUFFLED = 4 << 20


def bytes_of(spark: SparkSession, paths) -> int:
    """Size of files and folders on any file system Spark reads."""
    conf, total = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for p in paths:
        hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        total += hpath.getFileSystem(conf).getContentSummary(hpath).getLength()
    return total


def materialize(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """Cut lineage by writing a (small) result as a table in the shared
    folder and reading it back: one job, unlike ``checkpoint()``, which
    computes its input once to count and again to write. The folder goes when
    the application ends. ``large``: packed closer, and the shuffle files of the
    job go at once."""
    import uuid
    path = shared_dir(df.sparkSession, f"tabledocs/tables/{name}-{uuid.uuid4().hex}")
    if large:
        with shuffles_dropped(df.sparkSession):
            df.write.option("compression", "zstd").parquet(path)
    else:
        df.write.parquet(path)
    try:
        delete_at_end(df.sparkSession, path)
    except Exception:  # Spark Connect: the shared folder's owner clears it
        pass
    return df.sparkSession.read.schema(df.schema).parquet(path)


_ROW = "__row"


def is_ordered(df: DataFrame) -> bool:
    """Whether the frame's rows come in an order that was asked for."""
    return not df._jdf.queryExecution().executedPlan().outputOrdering().isEmpty()


def numbered(df: DataFrame) -> DataFrame:
    """An ordered frame with its rows' numbers, as a written table keeps no order."""
    return df.withColumn(_ROW, F.monotonically_increasing_id()) if is_ordered(df) else df


def in_order(df: DataFrame) -> DataFrame:
    """A table of ``numbered`` rows in its order."""
    return df.orderBy(_ROW).drop(_ROW) if _ROW in df.columns else df


def written_in_order(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` that keeps the order an ordered frame has."""
    return in_order(materialize(numbered(df), name))
