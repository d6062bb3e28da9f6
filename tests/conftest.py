import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidewright.session import build_session

    base = tmp_path_factory.mktemp("spark")
    s = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.checkpoint.dir": f"file://{base}/shared", "spark.sql.warehouse.dir": f"{base}/warehouse", "spark.driver.memory": "6g"})
    yield s
    s.stop()
