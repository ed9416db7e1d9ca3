"""Registered queries against their SQL in DuckDB, on the smallest tables."""



import duckdb
import pytest

from siftwell.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c



@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*names).collect()]
    rel = con.execute(SQL[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == names
    at = [cols.index(n) for n in names]
    want = [tuple(r[i] for i in at) for r in rel.fetchall()]
    assert len(got) == len(want)
    key = repr
    assert sorted(map(key, plain_each(got))) == sorted(map(key, plain_each(want)))
    spark.catalog.clearCache()


def plain_each(rows):
    return [tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in r) for r in rows]


def test_every_query_has_sql_but_the_hashes():
    assert set(QUERIES) - set(SQL) == {"hash_bucket", "feature_hash"}
