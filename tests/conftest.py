import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from acctpulse.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(os.environ.get("TEST_CPUS", "4"), "acctpulse-tests", "6g", f"file://{shared}")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("test tables not present")
    return DATA


@pytest.fixture
def rows(spark):
    """Build a frame from a schema text and tuples."""

    def build(schema, *tuples):
        return spark.createDataFrame(list(tuples), schema)

    return build
