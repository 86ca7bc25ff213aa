from __future__ import annotations

import os

import pytest

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def middle():
    return MIDDLE


@pytest.fixture(scope="session")
def small():
    return SMALL
