"""The operators' queries against their SQL in DuckDB on the same tables."""

import os

import duckdb
import pytest

from lodeseek.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_dir, name):
    c = duckdb.connect()
    for t in "documents pages benchmark conversations".split():
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    r = c.execute(ORACLE_SQL[name])
    columns = sorted(x[0] for x in r.description)
    at = [[x[0] for x in r.description].index(k) for k in columns]
    want = sorted((tuple(row[i] for i in at) for row in r.fetchall()), key=repr)
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == columns
    assert sorted((tuple(row[k] for k in columns) for row in df.collect()), key=repr) == want
