"""Every registered base query against its SQL on the smallest tables."""

import glob
import os

import pytest

from stackloom import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sql, name):
    got = queries.QUERIES[name](spark, SF)
    rows = got.collect()
    assert len(set(got.columns)) == len(got.columns)
    if name in queries.ORACLE_SQL:
        want = sql.execute(queries.ORACLE_SQL[name]).fetch_arrow_table() if hasattr(sql, "fetch_arrow_table") else sql.sql(queries.ORACLE_SQL[name]).df()
        columns = sorted(got.columns)
        frame = want.to_pandas() if hasattr(want, "to_pandas") else want
        assert sorted(frame.columns) == columns
        norm = lambda v: None if v is None or v != v else (round(v, 6) if isinstance(v, float) else v)
        a = sorted(str([norm(r[c]) for c in columns]) for r in rows)
        b = sorted(str([norm(getattr(v, "item", lambda v=v: v)()) for v in row]) for row in frame[columns].astype(object).itertuples(index=False))
        assert a == b
