"""Every registered query against its DuckDB oracle at sf0.01 (the driver's
correctness gate, run locally)."""
from __future__ import annotations

import pytest

import __spark_entry__ as E
from ragframe.plans import catalog
from helpers import duck_rows, spark_rows

ORACLES = {name: q for name, q in E.oracle_sql().items() if name in catalog.ORACLES}
QUERIES = {name: q for name, q in E.queries().items() if name in catalog.QUERIES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    rows, cols = spark_rows(df)
    orows, ocols = duck_rows(duck, ORACLES[name], cols)
    assert sorted(ocols) == cols
    assert len(rows) == len(orows)
    assert rows == orows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "rrf_score" in df.columns
