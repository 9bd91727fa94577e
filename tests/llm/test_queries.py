"""The registered queries against their statements, on the smallest tables."""

import pytest

from checks.compare import normal_rows, oracle_rows
from seedscape.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    result = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in result.collect()]
    assert rows
    if name in ORACLES:
        columns, expected = oracle_rows(SF, ORACLES[name])
        assert sorted(columns) == sorted(result.columns)
        assert normal_rows(result.columns, rows) == normal_rows(columns, expected)
