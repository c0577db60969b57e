"""Every query of the reference's operators against its SQL; those without SQL must return rows."""

import pytest

from tests.compare import assert_same
from tributary.queries import planner, relational, traces, workload

QUERIES = {k: f for m in (relational, workload, planner, traces) for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in (relational, workload, planner, traces) for k, q in m.ORACLES.items()}
SLOW = {"join_model_metrics"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, data, name):
    assert_same(QUERIES[name](spark, data), ORACLES[name], data)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
