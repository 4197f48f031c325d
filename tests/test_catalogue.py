"""Each query with an SQL twin gives the twin's rows; the others give rows."""

import os

import duckdb
import pytest

from echolark.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    df = df.astype(object).where(df.notna(), None)
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, tables):
    found = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLE_SQL:
        assert rows(found) == rows(tables.sql(ORACLE_SQL[name]).df())
    else:
        assert len(found)
