"""Every query of the library runs, and agrees with its SQL where it has one."""

import pytest
from conftest import SF
from oracle import answer, rows

from lodestar.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in catalog.ORACLES:
        want = answer(catalog.ORACLES[name], SF)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_filter_reaches_the_scan(spark):
    plan = catalog.QUERIES["F1_tenant_live"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src3)]" in plan or "EqualTo(source,src3)" in plan
    assert "text" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_ranks_are_cut_before_the_shuffle(spark):
    plan = catalog.QUERIES["R2_R6_W2_sparse_topk"](spark, SF)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
