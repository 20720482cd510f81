"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from depweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want, got = con.execute(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, small).toPandas()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = lambda df: sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)
