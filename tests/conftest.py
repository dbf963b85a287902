import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from cardinal.session import get_session

    return get_session(master="local[4]", shuffle_partitions=8)


@pytest.fixture(scope="session")
def con():
    from tests.oracle import duck

    return duck(SF)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")
