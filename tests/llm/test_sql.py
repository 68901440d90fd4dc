import duckdb
import pytest

from lexispan.llm.queries import queries
from lexispan.llm.sql import oracle_sql


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_agrees_with_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.sql(oracle_sql()[name])
    got = queries()[name](spark, sf)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [repr(tuple(r[c] for c in columns)) for r in got.collect()]
    assert sorted(rows) == sorted(map(repr, want.project(", ".join(columns)).fetchall()))
