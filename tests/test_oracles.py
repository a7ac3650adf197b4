"""Every registered query against its SQL on the smallest data folder."""

import os
import sys

import pytest
from conftest import SF_SMALL

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry
from oracle_compare import compare, connect

QUERIES, SQLS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_SMALL)


def test_every_sql_has_a_query():
    assert set(SQLS) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_matches_sql(spark, con, name):
    _, problem = compare(QUERIES[name](spark, SF_SMALL), con, SQLS[name])
    assert not problem, problem


# Queries that have a second way for large keys or groups, and a share of them to run it on.
LARGE = [
    "bed_timeline", "department_detail", "department_ranking", "encounter_sequence", "er_wait_times", "latency_p95",
    "length_of_stay", "los_baseline", "los_histogram", "los_summary", "mart_encounter_summary", "monthly_readmissions",
    "mv_department_performance", "prior_visits", "readmissions", "readmitted_flag", "scd2_merge", "temporal_join",
    "trailing_7d_visits", "training_set",
]


@pytest.mark.parametrize("name", LARGE)
def test_large_keys_give_the_same_result(spark, con, monkeypatch, name):
    """With the bar lowered, keys and groups of a few rows take the way meant for huge ones."""
    monkeypatch.setattr("wardline.operators.ordered.HOT_MIN_ROWS", 2 if name in ("scd2_merge", "mart_encounter_summary") else 12)
    _, problem = compare(QUERIES[name](spark, SF_SMALL), con, SQLS[name])
    assert not problem, problem
