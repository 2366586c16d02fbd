import os
import tempfile

import pytest

from vitalscope.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "vitalscope-tests", "4g")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vitalscope-tests-"))
    yield session
    session.stop()


@pytest.fixture
def folder():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("test tables not present")
    return path


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
