"""term_df: documents with each term, whether or not rows share an id."""

import duckdb
import pytest

from lexispan import catalogue

UNIQUE = [(1, "a b a"), (2, "b Ç — c"), (3, None), (4, ""), (5, "a")]
NULLS = [*UNIQUE, (None, "a only"), (None, "c")]


@pytest.mark.parametrize("rows", [UNIQUE, NULLS, [*NULLS, (1, "a d"), (1, "d"), (3, "b"), (6, "e e"), (6, "e"), (6, None), (7, None), (7, None)]])
def test_term_df_against_duckdb(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(catalogue.oracle_sql()["term_df"]).fetchall()
    got = catalogue.queries()["term_df"](spark, str(tmp_path))
    assert got.columns == ["term", "df"] and dict(got.dtypes)["df"] == "bigint"
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_no_pairs_are_shuffled(spark, sf):
    plan = catalogue.queries()["term_df"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" in plan and "hashpartitioning(doc_id" not in plan and not any("hashpartitioning(term" in x and "doc_id" in x for x in plan.splitlines())
