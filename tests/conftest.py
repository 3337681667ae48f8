import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="session")
def spark():
    from check_sql import spark_session

    from echotrail.session import prepare

    session = prepare(spark_session())
    yield session
    session.stop()


@pytest.fixture
def folder(spark):
    from echotrail.sources.files import scratch_path

    return scratch_path(spark, "test")
