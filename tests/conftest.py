import pytest

from quillspark.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", cores=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s
