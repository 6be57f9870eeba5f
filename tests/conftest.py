import pytest

from kotonoha.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, "6g")
    session.conf.set("kotonoha.join.salts", "4")
    yield session
    session.stop()
