"""The training-data queries that have SQL agree with DuckDB."""

import duckdb
import pytest

from dosewise.llm import queries
from tools.oracle_check import TABLES, duck_kind, norm_rows, spark_kind


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf, con, name):
    df = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert {f.name: spark_kind(f.dataType) for f in df.schema.fields} == {d[0]: duck_kind(d[1]) for d in cur.description}
    assert norm_rows(df.columns, [tuple(r) for r in df.collect()]) == norm_rows(cols, cur.fetchall())
