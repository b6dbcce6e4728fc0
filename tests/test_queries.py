"""Each registered query of the package's own operators against its DuckDB twin, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from lectern import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
registry.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if name not in registry.ORACLE_SQL:
        assert got
        return
    result = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=lambda k: names[k])
    assert got == sorted(repr(tuple(plain(r[k]) for k in order)) for r in result.fetchall())
