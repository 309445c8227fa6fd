"""Every registered query against its DuckDB oracle at sf0.01 (as the driver does)."""

import duckdb
import pytest

from conftest import ROOT, SF001  # noqa: F401
import __spark_entry__ as E
from vicinity import registry
from tools.compare import TABLES, digest

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    return c


def test_every_query_has_oracle_or_is_rows_only():
    rows_only = set(QUERIES) - set(ORACLES)
    assert rows_only == set()


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert [r["vec_id"] for r in rows][0] == 0 and len(rows) == 5


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    res = con.sql(ORACLES[name])
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(res.columns)
    assert len(rows) == len(orows)
    assert digest(rows, df.columns) == digest(orows, res.columns)
