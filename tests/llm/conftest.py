from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus  # noqa: E402


@pytest.fixture(scope="session")
def found():
    return corpus.rows()


@pytest.fixture(scope="session")
def docs(spark, found):
    return corpus.table(spark, found).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return corpus.table(spark, [])
