"""Every registered query against its SQL, on the smallest data."""

import re

import pytest

from conftest import SF_DIR
from oracle import compare

from lorebase.plans import REGISTRY


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_agrees_with_sql(spark, con, name):
    rows, _, problem = compare(spark, con, name, SF_DIR)
    assert problem is None, problem
    assert rows > 0


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


# A few rows of one-row or already bounded input may go to a single task.
_PLANS = [n for n in REGISTRY if not n.startswith(("snapshot_", "catalog_change_stream"))]


@pytest.mark.parametrize("name", _PLANS)
def test_plan_has_no_all_pairs_join(spark, name):
    plan = REGISTRY[name].run(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python
    assert not re.search(r"Window[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", plan)
