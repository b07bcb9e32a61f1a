import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
sys.path.insert(0, os.path.dirname(HERE))

from cuemill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(os.environ.get("TEST_CPUS", "8"), "tests", shuffle=4)
    yield s
    s.stop()
