from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemark.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    found = session(8, shuffle_partitions=4)
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
