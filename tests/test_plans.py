"""What the physical plans of the central operators look like."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from wareloom.operators import frontier, merges, ordering
from wareloom.operators.decode import decode_captures
from wareloom.operators.outcomes import classify_outcomes
from wareloom.operators.products import with_products
from wareloom.plans import runs
from wareloom.plans.registered import SECOND, _crawled
from wareloom.session import RunTables
from wareloom.sources import derived
from wareloom.sources.captures import read_captures


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pages(spark):
    return RunTables(spark, "plans").write(_crawled(spark, SF), "pages")


@pytest.fixture(scope="module")
def stored_captures(spark):
    tables = RunTables(spark, "plans")
    tables.write(derived.product_pages(spark, SF), "captures")
    return read_captures(spark, tables.path("captures"))


def test_top_of_the_frontier_is_a_heap_over_a_pushed_filter(pages):
    text = plan(frontier.pending_pages(pages, 10, 5).select("page_id", "url"))
    assert "TakeOrderedAndProject(limit=15, offset=5" in text
    assert "PushedFilters: [IsNull(visited_at)]" in text and "Exchange" not in text
    assert "scrape_status" not in text.split("ReadSchema")[1]


def test_slices_without_limit_do_not_meet_in_one_task(pages):
    text = plan(frontier.pending_pages(pages, 0, 5).select("page_id", "url"))
    assert "CollectLimit" not in text and "GlobalLimit" not in text
    above, single = text.split("Exchange SinglePartition")
    assert "HashAggregate(keys=[_part" in single and "url" not in single


def test_small_batches_do_not_shuffle_the_pages(spark, pages):
    outcomes = classify_outcomes(derived.fetch_results(derived.page_events(spark, SF)))
    text = plan(merges.apply_outcomes(pages, outcomes, SECOND))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_extraction_is_map_only(stored_captures):
    text = plan(with_products(decode_captures(stored_captures)))
    assert "Exchange" not in text and text.count("ArrowEvalPython") == 2


def test_scraping_never_shuffles_bodies(spark, stored_captures, monkeypatch):
    wanted = RunTables(spark, "plans").write(stored_captures.select("url"), "wanted")
    few = plan(runs._narrowed(stored_captures, wanted))
    assert "BroadcastHashJoin" in few and "Exchange hashpartitioning" not in few
    monkeypatch.setattr(runs, "BROADCAST_BYTES", 1)
    many = plan(runs._narrowed(stored_captures, wanted))
    assert "Join" not in many and "Exchange" not in many


def test_numbering_needs_one_range_shuffle(spark):
    rows = spark.range(100).select(F.col("id").alias("k"))
    text = plan(ordering.with_positions(rows, ["k"]))
    assert "rangepartitioning" not in text and "BroadcastHashJoin" in text
