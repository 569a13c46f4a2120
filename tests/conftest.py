import pytest

from siftwright.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("*", 8)
    session.sparkContext.setLogLevel("ERROR")
    return session
