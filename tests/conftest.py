import pytest

from gridloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 4, "tests")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
