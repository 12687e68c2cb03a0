import os

import duckdb
import pytest

from factweave.llm import queries as llm

SF = "/root/testdata/sf0.001"


def rows(frame, columns):
    plain = lambda x: None if x is None or x != x else x.item() if hasattr(x, "item") else x
    return sorted(repr(tuple(plain(x) for x in r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    got = llm.queries()[name](spark, SF).toPandas()
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(llm.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and rows(got, columns) == rows(want, columns)
