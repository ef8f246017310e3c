import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from pitspark.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", 4, 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
