import pytest

from multiweave.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    s = session("tests", master="local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(base / "checkpoints"), "spark.sql.warehouse.dir": str(base / "warehouse"), "spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
