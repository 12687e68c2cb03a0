import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return None if x is None or x != x else x.item() if hasattr(x, "item") else x


def rows(frame, columns):
    return sorted(repr(tuple(plain(x) for x in r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(entry.core.SQL))
def test_same_rows_as_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and rows(got, columns) == rows(want, columns)


def test_every_query_of_the_engine_has_sql():
    assert set(entry.core.QUERIES) == set(entry.core.SQL)
