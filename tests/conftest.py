import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vellumspark.session import build

    s = build("tests", "local[4]", **{"spark__sql__shuffle__partitions": "4", "spark__driver__memory": "4g", "spark__ui__showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
