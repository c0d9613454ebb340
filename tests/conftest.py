import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from souklens.session import local_session

    s = local_session(4, memory="4g", shuffle_partitions=4)
    yield s
    s.stop()
