import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from graphloom.session import local_session

    s = local_session(4, 2, "3g", "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
