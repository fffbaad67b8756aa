import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from botsift.session import local_session

    s = local_session(cores=8, app="botsift-tests", shuffle_partitions=8)
    yield s
    s.stop()
