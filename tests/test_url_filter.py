"""The Bloom filter of stored URLs loses none, at any fill, and keeps new ones away from the stored pages."""

import pytest
from pyspark.sql import functions as F

from wareloom.operators import url_filter
from wareloom.session import RunTables
from wareloom.streaming.capture_state import unseen_urls


def urls(spark, low, high):
    return spark.range(low, high).select(F.concat(F.lit("https://a/"), F.col("id").cast("string")).alias("url"), F.col("id").alias("cand_ord"))


def bits_set(known):
    return known.agg(F.sum(F.bitmap_count("bitmap"))).first()[0]


@pytest.mark.parametrize("bitmaps", [1, 2048])
def test_no_stored_url_is_lost(spark, monkeypatch, bitmaps):
    monkeypatch.setattr(url_filter, "BITMAPS", bitmaps)
    tables = RunTables(spark, "filter-test")
    known = tables.write(url_filter.url_filter(urls(spark, 0, 30_000)), "known")
    assert known.count() <= bitmaps and known.filter(F.octet_length("bitmap") != 4096).count() == 0
    assert url_filter.possible_keys(urls(spark, 0, 30_000), known).count() == 30_000
    strangers = url_filter.possible_keys(urls(spark, 30_000, 60_000), known).count()
    # One bitmap is nearly full, so nearly all have to be looked up; 2,048 are nearly empty.
    assert strangers > 20_000 if bitmaps == 1 else strangers <= 2
    pages = tables.write(urls(spark, 0, 30_000), "pages")
    got = unseen_urls(urls(spark, 29_990, 30_010).union(urls(spark, 30_000, 30_005)), pages, known)
    assert sorted(r.cand_ord for r in got.collect()) == list(range(30_000, 30_010))


def test_new_urls_are_not_looked_for_among_the_pages(spark):
    tables = RunTables(spark, "filter-test")
    pages = tables.write(urls(spark, 0, 5_000), "pages")
    known = tables.write(url_filter.url_filter(pages), "known")
    new = unseen_urls(urls(spark, 9_000_000, 9_000_050), pages, known)
    text = new._jdf.queryExecution().executedPlan().toString()
    assert new.count() == 50 and "pages" not in text and "Join" not in text and "Exchange" not in text
    # Nor are stored pages shuffled when some are known.
    mixed = unseen_urls(urls(spark, 4_990, 5_010), pages, known)
    text = mixed._jdf.queryExecution().executedPlan().toString()
    assert mixed.count() == 10 and "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_empty_and_odd_keys(spark):
    odd = spark.createDataFrame([("",), ("é" * 3000,), (None,), ("a",), ("a",)], "url string")
    known = url_filter.url_filter(odd)
    assert url_filter.possible_keys(odd, known).count() == 4
    assert 0 < bits_set(known) <= 16
    assert url_filter.possible_keys(odd, url_filter.url_filter(odd.limit(0))).count() == 0
