import pytest

import __spark_entry__ as entry_points
from compare import assert_same
from conftest import SF

from wareloom.plans.checks import CHECKS
from wareloom.plans.registered import QUERIES

# Queries whose results depend on positions, order of arrival or ties.
ORDERED = ["upsert_pages", "pending_pages_after", "failed_sitemaps", "scrape_log", "resolved_pages"]


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)
    assert set(QUERIES) <= set(entry_points.queries()) and set(CHECKS) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    result = QUERIES[name](spark, SF)
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "CartesianProduct" not in plan
    assert_same(result, SF, CHECKS[name])


@pytest.mark.parametrize("partitions", [2, 16])
@pytest.mark.parametrize("name", ORDERED)
def test_result_does_not_depend_on_partitioning(spark, name, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert_same(QUERIES[name](spark, SF), SF, CHECKS[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
