"""Every registered query against its DuckDB equivalent on the smallest tables."""

import os

import duckdb
import pytest

from bandloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df):
    def cell(v):
        return None if v is None or v != v else (round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))

    columns = sorted(df.columns)
    return columns, sorted([tuple(map(cell, row)) for row in df[columns].astype(object).itertuples(index=False)], key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLE_SQL:
        assert plain(got) == plain(db.sql(registry.ORACLE_SQL[name]).df())
    else:
        assert len(got)
