from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check import SPLIT_ALL  # noqa: E402
from marquee.operators.settle import drop_settled  # noqa: E402
from marquee.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    drop_settled(session)
    session.stop()


@pytest.fixture(params=["plain", "spread"])
def joins(request, spark):
    """Run a test with joins as Spark plans them, and with all of them shuffled and split."""
    before = {key: spark.conf.get(key, None) for key in SPLIT_ALL}
    if request.param == "spread":
        for key, value in SPLIT_ALL.items():
            spark.conf.set(key, value)
    yield request.param
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
