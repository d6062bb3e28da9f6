import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from oracle import duck, same
from tidewright.queries import batch, continuous

SF = "/root/testdata/sf0.001"
ALL, SQL = batch.QUERIES | continuous.QUERIES, batch.ORACLE | continuous.ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, con, name):
    same(ALL[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, name):
    assert ALL[name](spark, SF).count() > 0
