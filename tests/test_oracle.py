"""Every query that has an SQL twin agrees with it on the smallest tables."""

import pytest
from oracle_check import compare, connect

from threatweave.plans.catalog import MODELS, QUERIES
from threatweave.plans.oracle import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_same_rows(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLE[name], SF) is None


@pytest.mark.parametrize("name", ["linear_svm", "two_stage_v3", "url_rf"])
def test_models_run(spark, name):
    assert MODELS[name](spark, SF).count() > 0


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
