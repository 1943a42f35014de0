"""The operators' queries with SQL against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from folioscan.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_what_sql_gives(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(ORACLE_SQL[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    got = sorted(tuple(r) for r in df.select(*cols).collect())
    assert got and got == sorted(tuple(r[i] for i in at) for r in cur.fetchall())
