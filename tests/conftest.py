from __future__ import annotations

import pytest

from oracle_check import connect, session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    spark = session()
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def duck():
    return connect(SMALL)
