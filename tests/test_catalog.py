"""Every registered query against its SQL statement, at the smallest scale."""

import os

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry_module.queries()))
def test_query(spark, con, name):
    status, _, _ = compare(spark, con, name, FOLDER)
    assert status.startswith(("ok", "rows-only")), status


def test_entry(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
