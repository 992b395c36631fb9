import os

import pytest

os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")


@pytest.fixture(scope="session")
def spark():
    from strandweave.session import session

    conf = {"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}
    s = session("tests", **conf)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
