import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from cuebook.session import checkpoint_dir, local_session

    s = local_session(8, shuffle_partitions=8)
    checkpoint_dir(s)
    yield s
    s.stop()
