import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lamina.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, partitions=4, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s
