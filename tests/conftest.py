from __future__ import annotations

import pytest

from tests.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    yield session
    session.stop()
