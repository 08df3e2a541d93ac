import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from traceloom.session import local_session

    s = local_session(4, 4, "4g", "traceloom-tests")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def tiny(spark):
    log = [(f"t{i + 1}", e, p) for i, s in enumerate(["abcd", "abab", "acb", "b", "aabc"]) for p, e in enumerate(s)]
    return spark.createDataFrame(log, "trace string, event_type string, pos int").cache()
