import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from veilscore.session import clear_scratch, local_session
    s = local_session("*", shuffle_partitions=8, app_name="veilscore-tests")
    yield s
    clear_scratch(s)


@pytest.fixture()
def tmp_out(tmp_path):
    return str(tmp_path)
