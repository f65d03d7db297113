import pytest


@pytest.fixture(scope="session")
def spark():
    from kohesion.session import local_session

    session = local_session(cores=4, partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
