"""Every registered query of the bar engine against DuckDB, on the smallest tables."""

import pytest
from compare import assert_same, duck

from tidemark.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, SQL[name])


def test_queries_without_sql_are_tested_by_brute_force():
    """Their names, and where: random numbers or hashes are drawn that SQL does not have."""
    assert set(QUERIES) - set(SQL) == {"session_bootstrap", "permutation_null", "s0_run", "random_entry"}  # test_evidence.py, test_controls.py


def test_each_text_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
