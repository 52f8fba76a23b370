import pytest

from attesta.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", 4, "4g")
    yield session
    session.stop()


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
