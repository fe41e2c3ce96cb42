import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from paysieve.session import Workspace, build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("paysieve-tests", master="local[8]", partitions=4, driver_memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def ws(spark):
    return Workspace(spark)
