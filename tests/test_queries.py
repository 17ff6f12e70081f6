"""All queries of the library against DuckDB at the smallest scale."""

import os

import pytest

from quarrylake.plans import archives, briefs, formats, graphs, knowledge, outputs, packages, records

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = graphs.QUERIES | knowledge.QUERIES | records.QUERIES | outputs.QUERIES | packages.QUERIES | archives.QUERIES | briefs.QUERIES | formats.QUERIES
SQL = graphs.SQL | knowledge.SQL | records.SQL | outputs.SQL | packages.SQL | archives.SQL | briefs.SQL | formats.SQL
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    expected = sorted((tuple(plain(r[k]) for k in order) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=str) == expected


def test_queries_without_sql_run(spark):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
