import pytest

from kinweave.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    ship(session)
    yield session
    session.stop()
