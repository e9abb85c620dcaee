"""Every query of the reference's operators against its SQL."""

import subprocess
import sys

import pytest

from quern.queries import QUERIES, SQL
from tests.compare import SMALL, assert_same, duck


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_sql():
    assert {*QUERIES} == {*SQL}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert_same(QUERIES[name](spark, SMALL), con, SQL[name])


def test_entry_point_needs_no_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], check=True, timeout=120)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert {*__spark_entry__.oracle_sql()} <= {*__spark_entry__.queries()}
