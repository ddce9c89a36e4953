import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from allotment.session import local_session
    session = local_session("*", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def con():
    from check import duck
    return duck(FOLDER)


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    changed = {}

    def put(key, value):
        changed[key] = spark.conf.get(key, None)
        spark.conf.set(key, str(value))

    yield put
    for key, value in changed.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
