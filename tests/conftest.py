import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
FIXTURES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")


@pytest.fixture(scope="session")
def spark():
    from tabledocs.session import build_session, shared_dir
    s = build_session(master="local[*]", shuffle_partitions=8)
    shared_dir(s)
    yield s
    s.stop()


def one(spark, expr, value, schema="s string"):
    """Evaluate a column expression on one value."""
    from pyspark.sql import functions as F  # noqa: F401
    df = spark.createDataFrame([(value,)], schema)
    return df.select(expr(df.columns[0]).alias("r")).first()["r"]
