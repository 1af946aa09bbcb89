"""Lookups in documents keyed by name."""
import glob
import os

import pytest
from pyspark.sql import functions as F

from tabledocs.operators import keyed as K


def scan_of(df) -> str:
    plan = df._jdf.queryExecution().toString()
    return plan[plan.rindex("FileScan parquet"):]


def test_lookup_reads_few_files(spark, tmp_path):
    path = str(tmp_path / "docs")
    docs = spark.range(20_000).select(F.concat(F.lit("d"), "id").alias("name"), F.concat(F.lit("text of "), "id").alias("text"))
    K.write_keyed(docs.unionByName(docs.where("name = 'd7'")).unionByName(spark.createDataFrame([(None, "nameless")], "name string, text string")), path, buckets=16)
    files = len(glob.glob(f"{path}/bucket=*/*.parquet"))
    assert files == 16 == len([d for d in os.listdir(path) if d.startswith("bucket=")])
    one = K.lookup(spark, path, ["d123"])
    assert [tuple(r) for r in one.collect()] == [("d123", "text of 123")]
    scan = scan_of(one)
    assert "PartitionFilters: [isnotnull(bucket" in scan and "PushedFilters: [IsNotNull(name), EqualTo(name,d123)]" in scan
    table, buckets = K._table(spark, path)
    own = table.where(F.col("bucket") == K._bucket(F.lit("d123"), buckets))
    assert own.select(F.input_file_name()).distinct().count() == 1 and own.count() < 20_000 / 8
    assert K.lookup(spark, path, ["d7", "d8", "nope", ""]).count() == 3
    assert K.read_keyed(spark, path, "d9").first().text == "text of 9"
    with pytest.raises(LookupError, match="absent"):
        K.read_keyed(spark, path, "absent")
    names = spark.createDataFrame([("d1",), ("d2",), ("d2",), (None,), ("x",)], "name string")
    assert {r.name for r in K.lookup_many(spark, path, names).collect()} == {"d1", "d2"}


def test_numbers_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "docs")
    K.write_keyed(spark.range(500).select(F.col("id").alias("name"), F.lit("x").alias("text")), path, buckets=4, files=3)
    assert [r.name for r in K.lookup(spark, path, [42]).collect()] == [42]
    assert sorted(r.name for r in K.lookup_many(spark, path, spark.range(490, 510).toDF("name")).collect()) == list(range(490, 500))
