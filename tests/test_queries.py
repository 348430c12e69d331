"""Every registered query at the smallest scale; those with SQL must agree with it exactly."""

import pytest

from checks.catalogue import ORACLES, QUERIES
from checks.compare import compare, oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert len(got) > 0
    if name in ORACLES:
        assert compare(got, duck.execute(ORACLES[name]).df()) is None


def test_every_exact_query_has_sql():
    fitted = {"i1", "k10", "k11", "k12", "k13", "k14", "k15", "k19", "m12", "m13"}
    assert {n.split("_")[0] for n in QUERIES if n not in ORACLES} == fitted
