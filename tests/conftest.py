import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from playbill.session import build_session
    session = build_session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g",
                                         "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
