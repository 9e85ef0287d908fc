"""Every registered query against its DuckDB twin."""

import pytest

from tablescope.plans import ORACLES, QUERIES

from .conftest import SF_DIR
from .oracle import compare, duck, normal


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_equals_duckdb(spark, con, key):
    problem = compare(QUERIES[key](spark, SF_DIR), con, ORACLES[key])
    assert problem is None, problem


# trained models are slow; their behaviour has its own tests
FAST_ROWS_ONLY = sorted(k for k in set(QUERIES) - set(ORACLES) if not k.startswith("train_"))


@pytest.mark.parametrize("key", FAST_ROWS_ONLY)
def test_gives_rows(spark, key):
    assert QUERIES[key](spark, SF_DIR).limit(5).collect()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_comparison_sees_differences():
    a = normal(["x", "y"], [(1, 2.0), (3, None)])
    assert a == normal(["y", "x"], [(None, 3), (2.0, 1)])
    assert a != normal(["y", "x"], [(None, 3), (2.5, 1)])
    assert a != normal(["x", "y"], [(1, 2.0)])
