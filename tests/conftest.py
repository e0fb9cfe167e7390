import pytest

from siltra.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = local_session(4, **{"spark.checkpoint.dir": f"file://{shared}", "spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "2"})
    yield s
    s.stop()
