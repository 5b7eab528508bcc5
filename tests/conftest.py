import pytest

from quillon.session import session


@pytest.fixture(scope="session")
def spark():
    found = session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
