import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from cohortflow.session import checkpoint_dir, get_spark

    s = get_spark(master="local[*]", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s
