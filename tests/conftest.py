import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from kinespark import session

    found = session.local(4, 4)
    found.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield found
    found.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
