from datetime import datetime

import pytest

from tessera.functions.uri import Namespaces
from tessera.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4, "3g")


@pytest.fixture(scope="session")
def ns():
    return Namespaces({"res": "http://a.example/items/", "works": "http://w.example/id/", "ex": "http://x.example/ns#"})


@pytest.fixture
def at():
    return lambda day, hour=0: datetime(2020, 1, day, hour)
