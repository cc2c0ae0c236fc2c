"""Each registered query with an oracle gives its rows at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tessitura.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_rows_equal_oracle(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = _sorted(tuple(r[c] for c in cols) for r in df.collect())
    cur = con.execute(registry.ORACLE_SQL[name])
    theirs = [x[0] for x in cur.description]
    assert sorted(theirs) == cols
    at = [theirs.index(c) for c in cols]
    assert mine == _sorted(tuple(r[i] for i in at) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_give_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 50
