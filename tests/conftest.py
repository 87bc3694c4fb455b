import pytest

from loamwatch.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "6g")
    yield session
    session.stop()
