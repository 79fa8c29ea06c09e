from __future__ import annotations

import os

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from glossa.session import session

    s = session("local[4]", 4, "3g")
    s.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data() -> str:
    if not os.path.isdir(DATA):
        pytest.skip(f"{DATA} is missing")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    from tests.oracle import connection

    return connection(data)
