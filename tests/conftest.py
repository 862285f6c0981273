from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from larkspur.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    return build_session("local[4]", 4, spark__checkpoint__dir=f"file://{shared}", spark__driver__memory="6g")


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return DATA
