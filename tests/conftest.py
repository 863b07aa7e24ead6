import pytest

from tests.spark import session


@pytest.fixture(scope="session")
def spark():
    return session()
