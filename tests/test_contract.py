"""Every registered query against its SQL counterpart, on the smallest given tables."""

import os

import pytest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

if not os.path.isdir(FOLDER):
    pytest.skip("no test tables", allow_module_level=True)

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return con


def _plain(value):
    return repr(round(value, 9)) if isinstance(value, float) else repr(value)


def test_every_query_of_the_reference_part_has_sql():
    from cloakframe.plans.queries import all_queries

    assert set(all_queries()) <= set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in frame.collect())
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(tuple(_plain(r[i]) for i in order) for r in result.fetchall())
    assert got == expected


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
