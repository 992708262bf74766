import gzip
import json
import os
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wareloom.operators import frontier, merges
from wareloom.operators.outcomes import classify_outcomes
from wareloom.plans import runs
from wareloom.schemas import PAGES, STRUCTURED_PRODUCTS
from wareloom.session import checkpoint_root
from wareloom.sources.captures import read_captures, read_page_list
from wareloom.sources.state import CrawlState, read_state, write_state
from wareloom.streaming.capture_state import merge_stream, read_capture_stream, stream_capture_state, unseen_urls

NOW = datetime(2024, 1, 1)


def page(number, url, host, status="pending"):
    return (number, url, None, None, status, None, None, None, None, NOW, NOW, host)


def pages_of(spark, *rows):
    return spark.createDataFrame(list(rows), PAGES)


def stored(state, table="pages"):
    return sorted((r.host, r.page_id, r.scrape_status) for r in state.read(table).collect())


def snapshots(state):
    return sorted(os.listdir(state.root + "/pages"))


def test_a_snapshot_replaces_the_one_before(spark, run_dir):
    state = CrawlState(spark, run_dir + "/it's a state", 2)
    assert state.read("pages").count() == 0
    state.replace("pages", pages_of(spark, page(1, "https://a/1", "a"), page(2, "https://b/2", "b"), page(3, "https://123/3", "123")))
    reader = state.read("pages")
    known = state.read("pages")
    changed = known.filter("host <> 'a'").unionByName(pages_of(spark, page(1, "https://a/1", "a", "success"), page(7, "https://a/7", "a")))
    state.replace("pages", changed)
    after = [("123", 3, "pending"), ("a", 1, "success"), ("a", 7, "pending"), ("b", 2, "pending")]
    assert stored(state) == after
    assert sorted(r.scrape_status for r in reader.collect()) == ["pending"] * 3
    other = CrawlState(spark, state.root, 7)
    assert stored(other) == after
    other.replace("pages", other.read("pages").filter("page_id > 1"))
    assert stored(state) == after[:1] + after[2:]
    assert snapshots(state) == ["00000001-2", "00000002-2", "00000003-7"]


def test_a_change_is_seen_whole_or_not_at_all(spark, run_dir):
    state = CrawlState(spark, run_dir + "/s")
    state.replace("pages", pages_of(spark, page(1, "https://a/1", "a")))
    bad = pages_of(spark, page(1, "https://a/1", "a", "success"), page(2, "/x", None))
    with pytest.raises(PySparkException, match="cannot derive a state location"):
        state.replace("pages", bad)
    assert stored(state) == [("a", 1, "pending")]
    # What a writer leaves that dies before it is done, and the finished file of one that dies right after.
    state.replace("pages", pages_of(spark, page(1, "https://a/1", "a", "success"), page(9, "https://b/9", "b")))
    newest = f"{state.root}/pages/{snapshots(state)[-1]}"
    os.rename(newest + "/_SUCCESS", newest + "/_kept")
    again = CrawlState(spark.newSession(), run_dir + "/s")
    assert stored(again) == [("a", 1, "pending")]
    os.rename(newest + "/_kept", newest + "/_SUCCESS")
    assert stored(again) == [("a", 1, "success"), ("b", 9, "pending")]
    again.replace("pages", again.spark.createDataFrame([page(1, "https://a/1", "a", "failed")], PAGES))
    assert stored(state) == [("a", 1, "failed")]


def test_ids_go_on_from_the_stored_ones(spark, run_dir):
    state = CrawlState(spark, run_dir + "/s")
    state.replace("pages", pages_of(spark, page(4, "https://a/1", "a")))
    runs.listed_run_candidates(read_page_list(spark, urls=["https://a/3", "https://a/1"]), state, NOW)
    assert sorted((r.page_id, r.url) for r in state.read("pages").collect()) == [(4, "https://a/1"), (5, "https://a/3")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def many_pages(spark, run_dir):
    """A state of pages in eight buckets and a batch that Spark may not broadcast."""
    state = CrawlState(spark, run_dir + "/s")
    url = F.concat(F.lit("https://a/"), F.col("id").cast("string"))
    candidates = spark.range(5000).select(url.alias("url"), F.col("id").alias("cand_ord"))
    state.replace("pages", merges.seed_pages(state.read("pages"), candidates, NOW))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield state, candidates
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


def exchanges_of_stored_rows(df):
    """Shuffles above a scan of the stored snapshot, in a plan without adaptive execution."""
    found, above = [], []
    for line in plan(df).splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [entry for entry in above if entry[0] < depth] + [(depth, line)]
        if "SelectedBucketsCount" in line or "Bucketed: true" in line:
            found.extend(text for _, text in above if "Exchange hashpartitioning" in text)
    return found


def _outcomes(candidates):
    return classify_outcomes(
        candidates.select(
            "url", F.lit(200).alias("status_code"), F.lit("200 OK").alias("status_text"), F.lit(1).cast("bigint").alias("duration_ms"),
            F.lit(None).cast("string").alias("fetch_error"), F.lit(0).alias("batch_id"), F.col("cand_ord").alias("seq"),
        )
    )


def test_merges_do_not_move_stored_rows(spark, many_pages):
    state, candidates = many_pages
    merged = merges.apply_outcomes(state.read("pages"), _outcomes(candidates), NOW)
    assert "SortMergeJoin" in plan(merged) and "Bucketed: true" in plan(merged)
    assert not exchanges_of_stored_rows(merged)
    new = candidates.withColumn("url", F.concat("url", F.lit("/more")))
    unseen = unseen_urls(new, state.read("pages"))
    assert "Bucketed: true" in plan(unseen) and "SortMergeJoin" in plan(unseen)
    pending = frontier.pending_from_candidates(candidates, state.read("pages"))
    assert "Bucketed: true" in plan(pending) and not exchanges_of_stored_rows(pending)
    state.replace("pages", merged)
    assert state.read("pages").filter("scrape_status = 'success'").count() == 5000


def test_looking_up_a_url_reads_one_bucket(spark, many_pages):
    state, _ = many_pages
    one = frontier.page_by_url(state.read("pages"), "https://a/77")
    assert [r.url for r in one.collect()] == ["https://a/77"]
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        assert "SelectedBucketsCount: 1 out of 8" in plan(frontier.page_by_url(state.read("pages"), "https://a/77"))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    # Also where the planner does without a bucketed scan, files of other buckets are not opened.
    assert one.rdd.getNumPartitions() == 1 < state.read("pages").rdd.getNumPartitions()


def test_the_frontier_reads_pending_files_only(spark, many_pages):
    state, candidates = many_pages
    visited = merges.apply_outcomes(state.read("pages"), _outcomes(candidates.filter("cand_ord % 2 = 0")), NOW)
    state.replace("pages", visited)
    top = frontier.pending_pages(state.read_pending().select("page_id", "url", "visited_at"), 3)
    text = plan(top)
    assert "PartitionFilters: [isnotnull(pending" in text and "TakeOrderedAndProject" in text
    assert [r.url for r in top.collect()] == ["https://a/1", "https://a/3", "https://a/5"]
    found = {os.path.basename(os.path.dirname(f)) for f in state.read_pending().inputFiles()}
    assert found == {"pending=true"}


def test_runs_and_streams_keep_each_others_products(spark, captures, run_dir):
    state = CrawlState(spark, run_dir + "/s")
    for number, url in enumerate(["https://a/1", "https://a/2"], 1):
        chosen = runs.listed_run_candidates(read_page_list(spark, urls=[url]), state, NOW)
        summary, _ = runs.scrape_run(chosen, captures(dict(url=url, body=LD)), state, NOW)
        assert summary.first()["stored_products"] == number
    captures(dict(url="https://a/2", body=LD)).write.parquet(run_dir + "/in")
    for name in ("one", "two"):
        store = f"{run_dir}/{name}"
        for query in stream_capture_state(read_capture_stream(spark, run_dir + "/in"), store, store + "-offsets"):
            query.awaitTermination()
        run = merge_stream(state, store, NOW)
    merge_stream(state, store, NOW, batch_id=run)
    assert sorted(r.url for r in state.read("structured_products").collect()) == ["https://a/1", *["https://a/2"] * 3]


def test_undecodable_and_repeated_captures(spark, captures, run_dir):
    state = CrawlState(spark, run_dir + "/s")
    urls = ["https://a/br", "https://a/mixed", "https://a/twice"]
    chosen = runs.listed_run_candidates(read_page_list(spark, urls=urls), state, NOW)
    rows = captures(
        dict(url=urls[0], body=b"\x0b\x02\x80", content_encoding="br"),
        dict(url=urls[1], body=gzip.compress(b"\x0b\x02\x80"), content_encoding="br, gzip"),
        dict(url=urls[2], body=LD + LD, batch_id=1),
        dict(url=urls[2], body=LD, batch_id=2),
    )
    summary, outcomes = runs.scrape_run(chosen, rows, state, NOW)
    assert summary.first().asDict() == dict(pages_scraped=3, failures=2, stored_products=1)
    assert [(r.scrape_status, r.error) for r in outcomes.orderBy("seq").collect()] == [
        ("failed", "unsupported content encoding br"), ("failed", "unsupported content encoding br, gzip"), ("success", None)
    ]


def test_products_of_unknown_pages_are_failures(spark, captures, run_dir):
    state = CrawlState(spark, run_dir + "/s")
    chosen = read_page_list(spark, urls=["https://a/never-seeded"])
    summary, _ = runs.scrape_run(chosen, captures(dict(url="https://a/never-seeded", body=LD + LD)), state, NOW)
    assert summary.first().asDict() == dict(pages_scraped=1, failures=2, stored_products=0)


def test_failed_robots_are_records(spark, captures, run_dir):
    robots = captures(
        dict(url="https://a/robots.txt", body="Sitemap: https://a/s.xml"),
        dict(url="https://b/robots.txt", status_code=503, status_text="503 Busy"),
        dict(url="https://c/robots.txt", fetch_error="reset"),
    )
    maps = captures(dict(url="https://a/s.xml", body="<urlset><url><loc>https://a/1</loc></url></urlset>"))
    summary, records, _ = runs.resolve_run(maps, robots, CrawlState(spark, run_dir + "/s"), NOW)
    failed = {r["loc"]: r.error for r in records.filter("status = 'failed'").collect()}
    assert failed == {"https://b/robots.txt": "unexpected status 503 Busy", "https://c/robots.txt": "reset"}
    assert summary.first()["sitemaps_failed"] == 2


def test_batches_of_products_are_replaced_not_doubled(spark, run_dir):
    state = CrawlState(spark, run_dir + "/s")

    def rows(batch):
        return spark.createDataFrame([(1, "https://a/1", 0, 0, "{}", NOW, "a", batch)], STRUCTURED_PRODUCTS)

    for batch in (0, 1, 1):
        state.append_products(rows(batch))
    assert state.read("structured_products").count() == 2


def test_a_url_without_host_is_an_error(spark, run_dir):
    with pytest.raises(PySparkException, match="cannot derive a state location from URL /x"):
        write_state(pages_of(spark, page(1, "/x", "")), run_dir + "/p")


def test_a_state_per_host(spark, run_dir):
    assert CrawlState.for_url(spark, run_dir, "https://u@Shop.com:8/x").root == run_dir + "/Shop.com"
    assert CrawlState.for_url(spark, run_dir, "https://[::1]:8/x").root == run_dir + "/::1"
    with pytest.raises(ValueError, match="cannot derive a state location"):
        CrawlState.for_url(spark, run_dir, "/x")


def test_pages_without_host_are_kept(spark, captures, run_dir):
    robots = captures(dict(url="https://a/robots.txt", body="Sitemap: https://a/s.xml"))
    sitemaps = captures(dict(url="https://a/s.xml", body="<urlset><url><loc>/rel</loc></url><url><loc>https://a/1</loc></url></urlset>"))
    state = CrawlState(spark, run_dir + "/s")
    for _ in range(2):
        runs.resolve_run(sitemaps, robots, state, NOW)
    assert sorted((r.url, r.host) for r in state.read("pages").collect()) == [("/rel", "_"), ("https://a/1", "a")]
    _, outcomes = runs.scrape_run(runs.pending_run_candidates(state), captures(dict(url="https://a/1")), state, NOW)
    assert {r.url: r.error for r in outcomes.collect()} == {"/rel": "URL outside allowed domains", "https://a/1": None}
    assert state.read("pages").filter("visited_at IS NULL").count() == 0


def test_many_wanted_pages_are_not_broadcast(spark, captures, run_dir, monkeypatch):
    monkeypatch.setattr(runs, "BROADCAST_BYTES", 1)
    state = CrawlState(spark, run_dir + "/s")
    chosen = runs.listed_run_candidates(read_page_list(spark, urls=["https://a/1", "https://a/2"]), state, NOW)
    pages = captures(dict(url="https://a/1", body=LD), dict(url="https://a/2"), dict(url="https://a/3", body=LD))
    summary, _ = runs.scrape_run(chosen, pages, state, NOW)
    assert summary.first().asDict() == dict(pages_scraped=2, failures=0, stored_products=1)


def test_reading_one_host_prunes_folders(spark, run_dir):
    write_state(pages_of(spark, page(1, "https://a/1", "a"), page(2, "https://b/2", "b")), run_dir + "/p")
    one = read_state(spark, run_dir + "/p", PAGES, "a")
    assert [r.page_id for r in one.collect()] == [1]
    assert "PartitionFilters: [isnotnull(host" in one._jdf.queryExecution().executedPlan().toString()


def test_page_lists(spark, run_dir):
    entries = [{"loc": "https://a/1", "lastmod": "x"}, {"loc": ""}, {"lastmod": "y"}, {"loc": "https://a/1", "source_sitemap": "s"}, {"loc": "https://b/2", "extra": 1}]
    with open(run_dir + "/pages.json", "w") as out:
        json.dump(entries, out, indent=2)
    with open(run_dir + "/lines.json", "w") as out:
        out.write("\n".join(map(json.dumps, entries)))
    expected = ["u", "https://a/1", "https://a/1", "https://b/2"]
    for path, lines in (("/pages.json", False), ("/lines.json", True)):
        rows = read_page_list(spark, run_dir + path, ["u"], json_lines=lines).orderBy("cand_ord").collect()
        assert [(r.url, r.cand_ord) for r in rows] == list(zip(expected, range(4)))
    assert [r.url for r in read_page_list(spark, urls=["b", "a"]).orderBy("cand_ord").collect()] == ["b", "a"]
    with open(run_dir + "/bad.json", "w") as out:
        out.write('[{"loc": "a"')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_page_list(spark, run_dir + "/bad.json").collect()


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


LD = '<script type="application/ld+json">{"@type":"Product"}</script>'


@pytest.fixture
def shop(captures):
    robots = captures(dict(url="https://a/robots.txt", body="Sitemap: https://a/s.xml\nSitemap: https://a/lost.xml"))
    sitemaps = captures(
        dict(url="https://a/s.xml", body="<urlset><url><loc>https://a/1</loc></url><url><loc>https://a/2</loc></url><url><loc>https://b/3</loc></url></urlset>"),
    )
    pages = captures(
        dict(url="https://a/1", body=LD + LD, duration_ms=5),
        dict(url="https://a/2", body=LD, status_code=403, status_text="403 Forbidden"),
        dict(url="https://a/4", body=LD),
        dict(url="https://a/unknown", body=LD),
    )
    return robots, sitemaps, pages


@pytest.mark.parametrize("buckets", [1, 8])
def test_resolve_then_scrape_pending(spark, shop, run_dir, buckets):
    robots, sitemaps, pages = shop
    state = CrawlState(spark, run_dir + "/s", buckets)
    summary, _, _ = runs.resolve_run(sitemaps, robots, state, NOW)
    assert summary.first().asDict() == dict(sitemaps_attempted=2, sitemaps_succeeded=1, sitemaps_failed=1, sitemap_indexes=0, url_sets=1, final_urls=3, failed_pages=0)
    runs.resolve_run(sitemaps, robots, state, NOW)
    assert state.read("sitemaps").count() == 2 and state.read("pages").count() == 3
    summary, outcomes = runs.scrape_run(runs.pending_run_candidates(state, limit=2), pages, state, NOW, batch_id=1)
    assert summary.first().asDict() == dict(pages_scraped=2, failures=1, stored_products=2)
    assert [(r.url, r.error) for r in outcomes.orderBy("seq").collect()] == [("https://a/1", None), ("https://a/2", "unexpected status 403 Forbidden")]
    summary, outcomes = runs.scrape_run(runs.pending_run_candidates(state), pages, state, NOW, batch_id=2)
    assert [(r.url, r.error) for r in outcomes.collect()] == [("https://b/3", "not captured")]
    assert summary.first().asDict() == dict(pages_scraped=1, failures=1, stored_products=2)
    with pytest.raises(ValueError, match="no pages to scrape"):
        runs.scrape_run(runs.pending_run_candidates(state), pages, state, NOW)


def test_scrape_listed_pages(spark, shop, run_dir):
    _, _, pages = shop
    state = CrawlState(spark, run_dir + "/s")
    listed = read_page_list(spark, urls=["https://a/0", "https://a/1", "https://a/1", "https://a/4", "https://a/5"])
    chosen = runs.listed_run_candidates(listed, state, NOW, limit=3, skip=1)
    summary, _ = runs.scrape_run(chosen, pages, state, NOW, batch_id=1)
    assert summary.first().asDict() == dict(pages_scraped=3, failures=0, stored_products=5)
    resumed = runs.listed_run_candidates(listed, state, NOW)
    assert sorted(r.url for r in resumed.collect()) == ["https://a/0", "https://a/5"]
    everything = runs.listed_run_candidates(listed, state, NOW, resume=False)
    assert everything.count() == 5


def test_no_declared_sitemap_is_an_error(spark, captures, run_dir):
    robots = captures(dict(url="https://a/robots.txt", body="User-agent: *"))
    with pytest.raises(ValueError, match="declare no sitemap"):
        runs.resolve_run(robots, robots, CrawlState(spark, run_dir + "/s"), NOW)


def test_captures_round_trip(spark, shop, run_dir):
    shop[2].write.parquet(run_dir + "/c")
    rows = read_captures(spark, run_dir + "/c")
    assert rows.count() == 4
    narrow = rows.filter("status_code = 403").select("url")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status_code,403)" in narrow and "body" not in narrow.split("ReadSchema")[1]
