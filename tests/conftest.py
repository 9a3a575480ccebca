import pytest

from ethersense.session import configure, local_session


@pytest.fixture(scope="session")
def spark():
    session = configure(local_session(cpus=8, partitions=4, memory="8g"))
    yield session
    session.stop()
