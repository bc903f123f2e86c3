from __future__ import annotations

import os
from pathlib import Path

import pytest

from mailfleet.plans.session import local_session

DATA = Path(os.environ.get("MAILFLEET_TEST_DATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", "mailfleet-tests", **{
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.shuffle.partitions": "4",
    })
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder() -> str:
    return str(DATA)
