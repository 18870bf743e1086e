import pytest

from varve.session import get_spark


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_spark("tests", 4, spark__sql__shuffle__partitions="4", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
