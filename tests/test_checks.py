"""Every registered query against its check SQL on the smallest tables."""

import os

import pytest

from lightbox.workload import CHECKS, QUERIES
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_check(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, CHECKS[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - CHECKS.keys()))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
