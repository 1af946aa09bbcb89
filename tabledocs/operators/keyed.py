"""Documents as a table keyed by name: a lookup reads few files.

Rows are dealt to buckets (folders) by a hash of their name and sorted by name
within a file, with a Parquet Bloom filter on the name. A lookup names its
buckets as literals, so that other folders aren't listed into the scan; of the
files left, statistics and Bloom filters leave out the row groups that can't
hold the name. Names needn't be unique: all their rows are found.

Defined results: names of any type are keyed by their text, null names by the
empty one (but a lookup never gives them); an unknown name gives no row, or an
error where one document is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.caches import _FS

BUCKETS = 64
_MARK = "_BUCKETS"


def _bucket(name: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(name.cast("string"), F.lit(""))), F.lit(buckets)).cast("int")


def write_keyed(corpus: DataFrame, path: str, buckets: int = BUCKETS, files: int = 1) -> None:
    """``(name, text, ...)`` as a keyed table; ``files`` a bucket, for large ones."""
    spark = corpus.sparkSession
    spread = F.pmod(F.xxhash64(F.lit("file"), F.col("name").cast("string")), F.lit(files))
    (corpus.withColumn("bucket", _bucket(F.col("name"), buckets)).repartition(buckets * files, "bucket", spread)
     .sortWithinPartitions("bucket", "name").write.partitionBy("bucket")
     .option("parquet.bloom.filter.enabled#name", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path))
    _FS(spark).write_text(f"{path}/{_MARK}", str(buckets))


def _table(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    return spark.read.parquet(path), int(_FS(spark).read_text(f"{path}/{_MARK}"))


def lookup(spark: SparkSession, path: str, names: list) -> DataFrame:
    """The rows of some names, given on the driver."""
    table, buckets = _table(spark, path)
    kind = table.schema["name"].dataType
    # constant expressions: folded before the scan is planned
    found = table.where(F.col("bucket").isin(*[_bucket(F.lit(n).cast(kind), buckets) for n in names]) & F.col("name").isin(*[F.lit(n).cast(kind) for n in names]))
    return found.drop("bucket")


def lookup_many(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """The rows whose name is in the table ``names`` (name). The join is on bucket
    and name, so that buckets without a name are left out when it runs."""
    table, buckets = _table(spark, path)
    wanted = names.select(F.col("name").cast(table.schema["name"].dataType).alias("name")).where("name is not null").distinct()
    return table.join(wanted.withColumn("bucket", _bucket(F.col("name"), buckets)), ["bucket", "name"], "left_semi").drop("bucket")


def read_keyed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One document; an unknown name is an error."""
    found = lookup(spark, path, [name])
    if found.isEmpty():
        raise LookupError(f"no document is called {name!r}")
    return found
