"""Every registered job against its DuckDB SQL at sf0.01 (the correctness gate)."""
import os
import sys

import duckdb
import pytest

from conftest import ROOT, SF001, SF01

sys.path.insert(0, os.path.join(ROOT, "tools"))
import __spark_entry__ as E  # noqa: E402
from oracle_check import digest  # noqa: E402
from tabledocs.plans import registered  # noqa: E402
from tabledocs.session import TABLES  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registered.oracles()))
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF01)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_every_query_of_the_library_has_an_oracle():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(registered.jobs()) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["month", "revenue"]
