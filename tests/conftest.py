import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tandem.session import get_session

    session = get_session("tests", 4, 2)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
