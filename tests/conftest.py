"""One local session for all tests; shared folder of its own."""

import pytest

from inkquarry.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("4", 4, conf={"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
