"""Every query with SQL gives what DuckDB gives over the same tables; the others keep their invariants."""

import os

import duckdb
import pytest

from quillspark.plans import catalog


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(data):
        p = f"{data}/{f}"
        c.execute(f"create view {f.split('.')[0]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([r[i] for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    r = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, map(tuple, df.collect())) == rows(names, r.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_twice_the_same(spark, data, name):
    a, b = (sorted(map(str, catalog.QUERIES[name](spark, data).collect())) for _ in range(2))
    assert a and a == b


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3


def test_greedy_split_keeps_ratios(spark, data):
    got = {r["split"]: r["n"] for r in catalog.QUERIES["greedy_split"](spark, data).groupBy("split").agg({"size": "sum"}).withColumnRenamed("sum(size)", "n").collect()}
    assert got["train"] > got["val"] and got["train"] > got["test"]
