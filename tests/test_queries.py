"""Every query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from readingforge.plans import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    out = queries.QUERIES[name](spark, SF)
    if name not in oracle.SQL:
        assert out.count() >= 0
        return
    want = duck.execute(oracle.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(out.columns)
    rows = sorted([plain(r[columns.index(c)]) for c in sorted(columns)] for r in want.fetchall())
    assert sorted([plain(r[c]) for c in sorted(columns)] for r in out.collect()) == rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
