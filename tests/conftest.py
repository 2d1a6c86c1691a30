import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from gridseries.session import build_session

    s = build_session("local[*]", shuffle_partitions=8, app="gridseries-tests")
    yield s
    s.stop()


@pytest.fixture
def out_dir(spark):
    from gridseries.session import new_output_path

    return new_output_path(spark, "test")
