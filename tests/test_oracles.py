"""Every query outside llm against its SQL on the smallest tables, and the contract of the entry module."""

from pathlib import Path

import pytest

from larder.plans import registry
from tests.oracle import DATA, same

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    same(registry.queries()[name](spark, DATA), SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_same_with_one_partition(spark):
    """Results don't depend on the number of shuffle partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        for name in ("p5_profile", "p6_found", "repeat_item_swing_topk", "metric_latency_percentiles"):
            same(registry.queries()[name](spark, DATA), SQL[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
