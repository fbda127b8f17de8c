import os
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(TOP), str(TOP / "tests")]
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from quarrylight.session import local_session, ship

    s = ship(local_session(4, 4, "3g"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
