import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from feedspark.session import local_session, scratch_root

    s = local_session("*", shuffle_partitions=8, app="feedspark-tests")
    s.sparkContext.setLogLevel("ERROR")
    scratch_root(s)  # tests: a fresh temporary folder, since none is configured
    yield s
    s.stop()
