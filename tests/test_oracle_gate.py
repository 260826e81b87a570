"""A sample of the driver's correctness gate at sf0.001: Spark result == DuckDB oracle, exactly."""

import os

import duckdb
import pytest

from conftest import SF_SMALL

NAMES = ["file_facts", "functions", "near_duplicates", "all_duplicates", "smell_scores",
         "repo_metrics", "fix_plan", "smell_details", "render_markdown", "content_hash"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["lineitem", "documents", "pages"]:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return c


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF_SMALL)
    res = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(res.columns, res.fetchall())
