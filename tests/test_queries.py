"""Every query of the library against its DuckDB SQL on the smallest tables; those without SQL run."""

import pytest

from skeinwork.plans import catalogue
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, con, name):
    oracle.check(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLES[name])


def test_entry_runs_without_the_training_data_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
