from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from kindred.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "8g", **{"spark.sql.shuffle.partitions": "4"})
    ship(session)
    yield session
    session.stop()
