import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001
from feedspark.plans.catalog import all_queries
from feedspark.sources.tables import TABLES


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["channel", "feed_date", "received", "distinct_numbers", "duplicates", "first_seq",
                          "last_seq", "lost"]


def test_every_query_has_an_oracle():
    q, o = E.queries(), E.oracle_sql()
    assert set(all_queries()) <= set(o) <= set(q)


ALL = sorted(all_queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


@pytest.mark.parametrize("name", ALL)
def test_query_matches_oracle_sf0001(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(E.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    idx = [names.index(c) for c in cols]
    want = sorted(tuple(_norm(r[i]) for i in idx) for r in res.fetchall())
    assert got == want
