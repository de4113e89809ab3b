"""Every registered query against its SQL on the smallest tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, connection, name):
    result = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        result.count()
    else:
        assert compare(result, sql, connection) == ""


def test_entry(spark):
    assert not entry.entry(spark).isEmpty()


def test_queries_without_the_packages_of_one_part():
    code = (
        "import sys; sys.modules['ahocorasick'] = None; sys.modules['tokenizers'] = None\n"
        "import __spark_entry__ as e; import catalog\n"
        "assert set(e.queries()) == set(catalog.QUERIES); assert set(e.oracle_sql()) == set(catalog.ORACLES)"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, capture_output=True)
