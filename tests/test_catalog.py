"""Every registered query runs on sf0.001 and, where an oracle exists,
equals the DuckDB statement (row count, columns, values)."""
import os

import duckdb
import pytest

import __spark_entry__ as E
from dosewise.plans.catalog import QUERIES
from tools.oracle_check import TABLES, duck_kind, norm_rows, spark_kind

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_output_boundary_types(spark):
    from pyspark.sql import types as T
    from dosewise.plans import catalog
    # one run of each query (some land files or run a stream): its raw schema must be
    # what the oracle-side cast table says, and the boundary must leave no such type
    for name, fn in catalog.RAW.items():
        df = fn(spark, SF)
        dec = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
        txt = [f.name for f in df.schema.fields
               if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
        want = catalog.OUTPUT_CASTS.get(name, {"double": [], "string": []})
        assert (sorted(dec), sorted(txt)) == (sorted(want["double"]), sorted(want["string"])), name
        for f in catalog.finalize(df).schema.fields:
            assert not isinstance(f.dataType, (T.DecimalType, T.DateType, T.TimestampType,
                                               T.TimestampNTZType)), (name, f)


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["drug_key", "pay_band", "n", "avg_claims"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert len(rows) >= 1
        return
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(ocols)
    assert {f.name: spark_kind(f.dataType) for f in df.schema.fields} == \
        {d[0]: duck_kind(d[1]) for d in cur.description}
    assert norm_rows(cols, rows) == norm_rows(ocols, cur.fetchall())


def test_control_invariant_holds(spark):
    rows = E.queries()["dq_3_control_invariant"](spark, SF).collect()
    assert rows and all(r.ok for r in rows)


def test_uniqueness_holds(spark):
    assert all(r.duplicate_keys == 0 for r in E.queries()["dq_6_key_uniqueness"](spark, SF).collect())
