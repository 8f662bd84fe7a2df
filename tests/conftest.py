import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)


@pytest.fixture(scope="session")
def spark():
    from promptlens.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8)
    yield s
    s.stop()
