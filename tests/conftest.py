"""Shared Spark session for the test suite (local mode, small shuffles)."""

from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from reviewshift.session import get_spark
    scratch = tempfile.mkdtemp(prefix="run-tests-", dir="/tmp")
    os.environ["REVIEWSHIFT_SCRATCH"] = scratch
    s = get_spark("local[4]", app="reviewshift-tests", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def scratch(spark):
    return os.environ["REVIEWSHIFT_SCRATCH"]
