import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from gumshoe.session import get_spark

    session = get_spark("tests", "local[8]")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small_dir():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    return SMALL


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def names():
    return lambda df: sorted(r.name for r in df.collect())
