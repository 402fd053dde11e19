"""Every registered query at the smallest scale against its SQL."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, connection, name):
    problem = compare(spark, connection, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert problem is None or problem == "agree, but no rows", problem


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
