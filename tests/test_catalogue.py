"""Every registered query against its SQL on the small tables."""

import os

import duckdb
import pytest

from tracewarden.plans import catalogue, model_queries, source_queries, step_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    a = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(set(a.columns)) == len(a.columns)
    if name not in catalogue.SQL:
        assert len(a)
        return
    b = con.sql(catalogue.SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    tidy = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert tidy(a).equals(tidy(b))


def test_learned_automaton_keeps_its_traces(spark):
    rows = catalogue.QUERIES["dfa_induced_acceptance"](spark, SF).collect()
    assert rows and all(r["accepted"] == r["positive"] for r in rows)


def test_entry_has_the_queries(spark):
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
