"""Each registered query of the library proper against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from lexisift.plans import registry

SF = "/root/testdata/sf0.001"
SLOW = {"suggestions"}


def norm(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else round(v, 5)
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    return str(v) if v is not None and not isinstance(v, int | bool) else v


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in "documents pages benchmark labels conversations events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, tables, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    want = tables.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    a = sorted((tuple(norm(r[c]) for c in order) for r in got), key=repr)
    b = sorted((tuple(norm(dict(zip(names, r))[c]) for c in order) for r in want.fetchall()), key=repr)
    assert a == b


def test_queries_without_sql(spark):
    for name in set(registry.QUERIES) - set(registry.SQL):
        assert registry.QUERIES[name](spark, SF).count() > 0
