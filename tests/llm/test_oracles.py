"""The operators' SQL in DuckDB."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import compare
from gridstone.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_sql(spark, name):
    assert compare.differs(spark, compare.connect(DATA), DATA, queries.queries()[name], queries.oracle_sql()[name]) is None
