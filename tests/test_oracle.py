"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import math

import pytest

import __spark_entry__ as entry
from conftest import SMALL_SF
from vocabshift.plans.catalog import QUERIES as CATALOG

# the optional subpackage registers its own queries and tests them itself
QUERIES = {name: entry.queries()[name] for name in CATALOG}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in CATALOG}


def _canon(v):
    if isinstance(v, float):
        return round(v, 9) if not math.isnan(v) else "nan"
    return v


def _bag(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_canon(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    result = QUERIES[name](spark, SMALL_SF)
    got = [tuple(r) for r in result.collect()]
    rel = duck.sql(ORACLES[name])
    want = rel.fetchall()
    assert sorted(result.columns) == sorted(rel.columns)
    assert len(got) == len(want)
    assert _bag(got, result.columns) == _bag(want, rel.columns)


def test_entry_smoke(spark):
    out = entry.entry(spark)
    assert "new_mapped_concept_id" in out.columns
    assert out.count() >= 0
