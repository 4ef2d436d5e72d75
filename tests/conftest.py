import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from mendframe.session import local_session

    return local_session(8, "mendframe-tests")


@pytest.fixture(scope="session")
def con():
    from compare import duck

    return duck(SF)
