"""Every query that has a statement gives the statement's rows."""

import pytest

from checks import ORACLES, QUERIES
from checks.compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_statement(spark, name):
    good, note = compare(spark, SF, name)
    assert good, note


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) >= set(QUERIES)
