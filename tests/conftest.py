import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from wardline.session import local_session

    session = local_session("tests", "4", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def star(spark):
    from wardline.sources.star import Star

    return Star(spark, SF_SMALL)


@pytest.fixture
def ts():
    from datetime import datetime

    return datetime.fromisoformat
