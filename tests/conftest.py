from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from gridwise.session import session

    s = session("local[4]", "4g", 4, spark_checkpoint_dir=f"file://{tmp_path_factory.mktemp('shared')}")
    yield s
    s.stop()
