import pytest

from graphmill.session import get_spark


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = get_spark("tests", 8, **{"spark__checkpoint__dir": str(shared), "spark__sql__shuffle__partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
