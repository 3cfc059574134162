import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TESTDATA = os.environ.get("GROUNDWORK_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from groundwork.session import local_session, share_package

    session = local_session(cores=4, memory="4g", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    share_package(session, ROOT)
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return f"{TESTDATA}/sf0.001"
