"""The registered queries on the smallest tables, against their SQL where they have any."""

import glob
import os

import duckdb
import pytest

from likenet.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    got = QUERIES[name](spark, DATA)
    rows, columns = got.collect(), sorted(got.columns)
    assert rows
    if name not in ORACLE_SQL:
        return
    db = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in rows) == sorted(want)
