"""Every query with SQL gives the SQL's rows over the smallest tables."""

import duckdb
import pytest

from quillstone import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations benchmark".split()


def rows(columns, found):
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(value(r[columns.index(c)]) for c in sorted(columns)) for r in found), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    df, sql = queries.QUERIES[name](spark, SF), duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(sql.columns, sql.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert "search_topk" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
