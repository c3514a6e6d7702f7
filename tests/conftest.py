import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from promolift.session import build_session
    return build_session(os.environ.get("PROMOLIFT_TEST_MASTER", "local[4]"), shuffle_partitions=4)
