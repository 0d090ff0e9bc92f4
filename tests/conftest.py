import pytest

from holdfast.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", master="local[8]", cores=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one():
    """The only row of a frame as a dict."""

    def read(df):
        rows = df.collect()
        assert len(rows) == 1
        return rows[0].asDict()

    return read
