"""Every registered query of the catalogue against its SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import compare
from gridstone.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(DATA)


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, con, name):
    if name in catalogue.oracle_sql():
        assert compare.differs(spark, con, DATA, catalogue.queries()[name], catalogue.oracle_sql()[name]) is None
    else:
        assert catalogue.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
