import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from laplake.session import build_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "laplake-tests", "local[8]", **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as a sorted list, floats rounded."""

    def collect(df, *names, digits=6):
        names = names or df.columns
        out = [
            tuple(round(v, digits) if isinstance(v, float) else v for v in row)
            for row in df.select(*names).collect()
        ]
        return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))

    return collect
