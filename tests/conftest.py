import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barspark.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("local[8]", shuffle_partitions=4, spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"
