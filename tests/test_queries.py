"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import differences

from __spark_entry__ import entry, oracle_sql, queries


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    if name in oracle_sql():
        assert differences(df, sf_dir, oracle_sql()[name]) == []
    else:
        assert df.count() > 0


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["rec_id", "match_id", "cluster_id", "duplicate_label"]
    assert df.count() == 196
