"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabledocs.session import shared_dir

#: Rows of one Arrow batch handed to a Python step. With texts of some kB this
#: is a few MB; the steps themselves cut a batch further by characters.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Keep the Arrow batches that carry texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written in the shared folder and read back: computed
    once, no lineage behind it, readable after any executor is lost. The
    folder goes when the application ends."""
    import uuid
    spark = df.sparkSession
    path = shared_dir(spark, f"tabledocs/llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """The name as a column reference, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def text_key(id_col: str, text_col: str) -> list[Column]:
    """(k1, k2): 128 bits of a row's id and text. Rows alike in both are one document."""
    key = [F.col(quoted(id_col)).cast("string"), F.col(quoted(id_col)).isNull(), F.col(quoted(text_col)), F.col(quoted(text_col)).isNull()]
    return [F.xxhash64(F.lit(1), *key).alias("k1"), F.xxhash64(F.lit(2), *key).alias("k2")]


def row_of(df: DataFrame, *without: str) -> Column:
    """A struct of the columns but those, whatever their names."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns if c not in without]).alias("row")


def fold(col: str | Column, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; null for null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary")) % n


def unit_hash(*cols) -> Column:
    """A uniform number in [0, 1) from the values of the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def chunks_by_chars(texts: list, limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of ``texts`` with at most ``limit`` characters together
    (one longer text is a run of its own)."""
    i, n = 0, 0
    for j, t in enumerate(texts):
        k = len(t) if t else 0
        if j > i and n + k > limit:
            yield i, j
            i, n = j, 0
        n += k
    if i < len(texts):
        yield i, len(texts)


def with_columns(batch: pa.RecordBatch, drop: tuple[str, ...], **new) -> pa.RecordBatch:
    """The batch without the columns in ``drop``, with ``new`` at its end."""
    names = [n for n in batch.schema.names if n not in drop]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(new.values()),
                                      names=names + list(new))


def mix64(x):
    """SplitMix64's finaliser on a uint64 array: a bijection that spreads bits."""
    import numpy as np
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
