"""Every catalogue query equals its DuckDB oracle (rows, columns, values)."""
from __future__ import annotations

import pytest

import __spark_entry__ as entry
from conftest import SF_CHECK
from tools.check_oracles import compare, duck, rows_of
from wagelens.plans import catalog

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


def test_every_query_has_an_oracle():
    assert set(catalog.oracle_sql()) == set(catalog.queries())
    assert set(catalog.queries()) <= set(entry.queries()) and set(catalog.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = catalog.queries()[name](spark, SF_CHECK).toPandas()
    want = con.sql(catalog.oracle_sql()[name]).df()
    cols_a, rows_a = rows_of(got)
    cols_b, rows_b = rows_of(want)
    assert cols_a == cols_b
    ok, msg = compare(rows_a, rows_b)
    assert ok, msg


def test_entry_runs_on_smallest_scale(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["yr", "bin_idx", "bin_label", "n", "n_total", "pct", "pct_err"]


SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", NAMES)
def test_query_types_match_oracle(spark, con, name):
    got = {f.name: SQL_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
           for f in catalog.queries()[name](spark, SF_CHECK).schema.fields}
    rel = con.sql(catalog.oracle_sql()[name])
    assert got == {c: str(t) for c, t in zip(rel.columns, rel.types)}
