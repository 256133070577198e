"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
import check

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return check.connect(SF_DIR)


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    problem = check.compare(spark, db, SF_DIR, entry.queries()[name], entry.oracle_sql().get(name))
    assert problem is None, problem
