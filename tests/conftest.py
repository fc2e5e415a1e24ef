import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sonarium.session import build_session

    scratch = tempfile.mkdtemp(prefix="spark-")
    session = build_session(
        "tests", master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__local__dir=scratch, spark__checkpoint__dir=scratch + "/shared",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
