"""Every query that SQL can express against DuckDB on the smallest tables."""

import duckdb
import pytest

from docmill.jobs import catalogue, workflows

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.QUERIES | workflows.QUERIES, catalogue.ORACLES | workflows.ORACLES
TABLES = "events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    rows = sorted((tuple(r[c] for c in order) for r in got.collect()), key=str)
    assert rows == sorted((tuple(r[names.index(c)] for c in order) for r in want.fetchall()), key=str)


def test_entry_point_has_every_query():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
