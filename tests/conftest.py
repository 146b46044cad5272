import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from rewardlens.session import checkpoint_dir, get_session

    s = get_session("local[4]", 4)
    checkpoint_dir(s)  # sets a private folder only because the session names none
    yield s
