import pytest

from lookalike.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, memory="4g")
    yield session
    session.stop()
