"""Every registered query against its SQL on the small tables."""

import math
import os

import duckdb
import pytest

from datakiln.plans import catalog
from tests.conftest import SF


def _norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return f"{v:.6g}" if isinstance(v, float) else v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for n in os.listdir(SF):
        con.sql(f"create view {n.removesuffix('.parquet')} as select * from '{SF}/{n}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(repr([_norm(r[c]) for c in columns]) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        assert ours
        return
    got = tables.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == columns
    theirs = sorted(repr([_norm(r[got.columns.index(c)]) for c in columns]) for r in got.fetchall())
    assert ours == theirs
