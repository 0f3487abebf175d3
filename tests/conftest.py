import pytest

from foliospark.session import session


@pytest.fixture(scope="session")
def spark():
    return session(4, 4, spark__driver__memory="4g")
