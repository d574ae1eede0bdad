import pytest

from tracelake.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = "file://" + str(tmp_path_factory.mktemp("shared"))
    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.checkpoint.dir": shared}
    session = build_session("tests", cpus=4, **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
