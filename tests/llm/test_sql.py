import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from oracle import duck, same  # noqa: E402

from tidewright.llm.queries import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, name):
    assert same(QUERIES[name](spark, SF), duck(SF), ORACLE[name]) > 0
