"""The driver's correctness gate, in miniature: every query with an oracle
must equal DuckDB on the same parquet (sf0.001, which has calendar gaps)."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import ROOT, SF_SMALL
from wardcast.sources.tables import TABLES, table_path

sys.path.insert(0, os.path.join(ROOT, "tools"))
from check_oracle import _rows  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(dcols, cur.fetchall())


def test_every_query_runs_and_entry(spark):
    assert set(E.oracle_sql()) <= set(E.queries())
    df = E.entry(spark)
    assert df.count() > 0 and "SOFA" in df.columns
