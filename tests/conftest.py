import pytest

from strata3d import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session.build("local[4]", "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("spark-checkpoints")))
    yield s
    s.stop()
