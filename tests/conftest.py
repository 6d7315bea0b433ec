import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from talus.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", shuffle_partitions=4, memory="3g")
    yield s
    s.stop()
