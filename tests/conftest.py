"""One local session for all tests."""

from __future__ import annotations

import pytest

from evalforge.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = local_session(4, "4g", **{"spark.checkpoint.dir": f"file://{folder}", "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
