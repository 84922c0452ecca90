import os

import pytest

os.environ.setdefault("BENCH_CPUS", "4")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tesela.session import get_spark

    session = get_spark("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SMALL):
        pytest.skip("test tables are not there")
    return SMALL
