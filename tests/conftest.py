from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from fleetbook.session import build_session, checkpoint_dir

    s = build_session(master="local[*]", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def duck_check():
    from oracle_harness import duck

    return duck(SF_CHECK)


@pytest.fixture(scope="session")
def tables_check(spark):
    from fleetbook.sources.fixtures import TestdataTables

    return TestdataTables(spark, SF_CHECK)
