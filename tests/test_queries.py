"""Every registered query against its check SQL on whole tables."""

import duckdb
import pytest

from sightline.plans import all_checks, all_queries
from tools.check import TABLES, canonical

SF = "/root/testdata/sf0.001"
CHECKS, QUERIES = all_checks(), all_queries()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = db.execute(CHECKS[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
