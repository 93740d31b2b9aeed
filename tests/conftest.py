import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from wayfield.session import build_session

    session = build_session("tests", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    return session
