"""Every catalog query with an oracle against DuckDB, and the rows-only ones for shape, at sf0.001."""

import pytest

import __spark_entry__ as E
from tests.compare import compare_one, duck
from tests.conftest import SF_SMALL

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    r = compare_one(spark, con, SF_SMALL, name, QUERIES[name], ORACLE[name])
    assert r["cols"], (r["spark_cols"], r["duck_cols"])
    assert r["rows"], (r["n_spark"], r["n_duck"])
    assert r["values"], (r["s_sample"], r["d_sample"])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0
    assert df.columns


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and "prev_clicks" in df.columns


def test_entry_equals_stored_path(spark):
    inline = [tuple(r) for r in E.entry(spark).collect()]
    stored = [tuple(r) for r in QUERIES["report_kpis"](spark, SF_SMALL).collect()]
    assert inline == stored
