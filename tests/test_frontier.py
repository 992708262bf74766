from datetime import datetime

import pytest

from wareloom.operators import frontier, joins, ordering
from wareloom.schemas import PAGES
from wareloom.streaming.capture_state import unseen_urls

SEEN = datetime(2024, 1, 1)


def page(number, visited=False, url=None):
    return (number, url or f"https://h{number % 3}.com/{number}", None, None, "pending", None, None, None,
            SEEN if visited else None, SEEN, SEEN, f"h{number % 3}.com")


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([page(n, visited=n % 4 == 0) for n in range(1, 41)], PAGES)


def candidates(spark, *urls):
    return spark.createDataFrame(list(zip(urls, range(len(urls)))), "url string, cand_ord long")


@pytest.mark.parametrize("limit,offset", [(0, 0), (5, 0), (5, 7), (0, 7), (0, 100), (100, 0), (5, 100)])
@pytest.mark.parametrize("heap", [0, 1000])
def test_pending_pages(pages, monkeypatch, limit, offset, heap):
    monkeypatch.setattr(ordering, "TOP_K_ROWS", heap)
    expected = [n for n in range(1, 41) if n % 4][offset:][: limit or None]
    assert [r.page_id for r in frontier.pending_pages(pages, limit, offset).collect()] == expected


def test_pending_from_candidates_keeps_order_and_repeats(spark, pages):
    urls = [f"https://h{n % 3}.com/{n}" for n in (9, 4, 7, 9, 99, 1)]
    rows = frontier.pending_from_candidates(candidates(spark, *urls), pages)
    assert [r.page_id for r in rows.collect()] == [9, 7, 9, 1]
    rows = frontier.pending_from_candidates(candidates(spark, *urls), pages, limit=2)
    assert [r.page_id for r in rows.collect()] == [9, 7]


def test_lookup_by_url(spark, pages):
    assert [r.page_id for r in frontier.page_by_url(pages, "https://h1.com/7").collect()] == [7]
    assert frontier.page_by_url(pages, "https://h1.com/x").count() == 0
    wanted = candidates(spark, "https://h1.com/7", "https://h2.com/8", "nowhere")
    assert sorted(r.page_id for r in frontier.pages_by_url(pages, wanted).collect()) == [7, 8]


def test_slices(spark, monkeypatch):
    rows = candidates(spark, *"abcdef")
    for heap in (0, 1000):
        monkeypatch.setattr(ordering, "TOP_K_ROWS", heap)
        assert [r.url for r in frontier.slice_candidates(rows, 2, 3).collect()] == list("cde")
        assert [r.url for r in frontier.slice_candidates(rows, 4).collect()] == list("ef")
        assert [r.url for r in frontier.slice_candidates(rows, 0, 2).collect()] == list("ab")
    with pytest.raises(ValueError, match="cannot skip 6 of 6"):
        frontier.slice_candidates(rows, 6)


def test_allowed_domains(spark):
    rows = candidates(spark, "https://b.com/1", "https://A.com", "/x", "https://b.com/2", "https://a.com", "http://c.com:80/")
    assert [r.host for r in frontier.allowed_domains(rows).collect()] == ["b.com", "A.com", "a.com", "c.com"]
    with pytest.raises(ValueError, match="cannot be parsed"):
        frontier.allowed_domains(candidates(spark, "https://a.com", "https://a.com/%zz"))
    with pytest.raises(ValueError, match="no page URL has a host"):
        frontier.allowed_domains(candidates(spark, "/x", ""))


@pytest.mark.parametrize("small_rows", [0, 1000])
def test_filter_allowed(spark, monkeypatch, small_rows):
    join = joins.small_or_lookup_join
    monkeypatch.setattr(frontier, "small_or_lookup_join", lambda *a, **k: join(*a, small_rows=small_rows, **k))
    domains = spark.createDataFrame([("a.com",), ("b.com",)], "host string")
    urls = ["https://a.com/1", "https://A.com/1", "https://b.com:1/2", "https://c.com", "/x", "https://a.com/%zz", "https://a.com/1"]
    got = sorted((r.cand_ord, r.allowed) for r in frontier.filter_allowed(candidates(spark, *urls), domains).collect())
    assert [allowed for _, allowed in got] == [True, False, True, False, False, False, True]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_spread_and_nothing_is_lost(spark, how):
    left = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 50)) AS url", "id AS n")
    left = left.unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS url, CAST(9999 AS BIGINT) AS n"))
    right = spark.range(40).selectExpr("if(id = 0, 'hot', concat('k', id)) AS url", "id AS v")
    plain = left.join(right, "url", how)
    salted = joins.lookup_join(left, right, "url", how, hot_rows=100, salts=8)
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))
    hot = joins.lookup_join(left, right.hint("shuffle_hash"), "url", how, hot_rows=100, salts=8)
    largest = hot.filter("url = 'hot'").selectExpr("spark_partition_id() AS p").groupBy("p").count()
    assert largest.count() > 1


def test_positions_are_dense(spark):
    rows = spark.range(1000).selectExpr("id * 7 % 1000 AS k", "id")
    placed = ordering.with_positions(rows, ["k"], "position", total="total").collect()
    assert all(r.position == r.k + 1 and r.total == 1000 for r in placed) and len(placed) == 1000


def test_unseen_urls_are_taken_once(spark, pages):
    arriving = candidates(spark, "new", "https://h1.com/7", "new", "other")
    assert sorted(map(tuple, unseen_urls(arriving, pages).collect())) == [("new", 0), ("other", 3)]
