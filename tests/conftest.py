import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--conf spark.ui.enabled=false --conf spark.ui.showConsoleProgress=false "
                                             "--driver-memory 6g pyspark-shell")


@pytest.fixture(scope="session")
def spark():
    from millwright import session
    s = session.build("tests", "local[8]", 4)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
