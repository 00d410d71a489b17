"""One small session for all tests, with its folders in pytest's temporary space."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from parapet.session import session

    base = tmp_path_factory.mktemp("spark")
    s = session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.driver.host": "127.0.0.1",
            "spark.sql.warehouse.dir": str(base / "warehouse"),
            "spark.local.dir": str(base / "local"),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
