import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from qaloom.session import local_session, ship

    session = local_session(4, 4, "4g")
    ship(session)
    yield session


@pytest.fixture(scope="session")
def sf() -> str:
    return "/root/testdata/sf0.001"
