import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    assert difference(spark, SF, name) is None


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["group", "label", "seg_idx", "lead_idx", "pos", "value"]
    assert rows.count() == 82 * 12 * 24
