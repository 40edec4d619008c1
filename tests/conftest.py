"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from corpuscle.session import get_session

    session = get_session(4, spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()
