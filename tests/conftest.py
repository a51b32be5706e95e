import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from docspark.session import local_session

    session = local_session("tests", os.environ.get("TEST_CPUS", "8"))
    yield session
    session.stop()
