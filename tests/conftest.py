import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from formloom.plans.registry import Source  # noqa: E402
from formloom.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "formloom-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    return Source(spark, SMALL)
