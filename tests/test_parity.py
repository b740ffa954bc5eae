"""Every query with an SQL form gives the same rows, and every other one gives some."""

import pytest
from conftest import SF_DIR
from parity import compare, connect

from tillspark.plans import catalog, model_queries


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.fixture(autouse=True)
def few_rounds(monkeypatch):
    monkeypatch.setattr(model_queries, "ROUNDS", 5)
    monkeypatch.setattr(model_queries, "TREES", 5)


MAY_BE_EMPTY = {"flt_having", "proc_affinity", "proc_affinity_distinct", "flt_between_interval"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    problem = compare(df, duck, catalog.ORACLES[name])
    if name in MAY_BE_EMPTY and problem == "empty on both sides":
        return
    assert problem is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).count() > 0
