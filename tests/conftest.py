import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from helixframe.session import get_session  # noqa: E402

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "helixframe-tests", master="local[4]", **{"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return f"{TESTDATA}/sf0.001"


def rows(df):
    """Rows as dicts, in a stable order."""
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: str(sorted(r.items(), key=str)))
