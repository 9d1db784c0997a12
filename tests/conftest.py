import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cohortloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", 8, **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
