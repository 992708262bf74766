import os
import shutil
from datetime import datetime

from pyspark.sql import functions as F

from wareloom.operators import merges
from wareloom.schemas import PAGES
from wareloom.sources.state import CrawlState
from wareloom.streaming.capture_state import (
    ROCKS_DB,
    STATE_STORE,
    merge_stream,
    read_capture_stream,
    stream_capture_state,
    stream_pages,
    stream_products,
)

NOW = datetime(2024, 1, 1)
LD = '<script type="application/ld+json">{"@type":"Product"}</script>'


def lots(captures):
    return [
        captures(dict(url="https://a/1", body=LD), dict(url="https://a/2", status_code=500, status_text="500 Oops")),
        captures(dict(url="https://b/3", body=LD), dict(url="https://a/2", body=LD + LD), dict(url="https://a/1", fetch_error="reset")),
    ]


def pages_of(state):
    return sorted((r.page_id, r.url, r.scrape_status, r.status_code, r.error) for r in state.read("pages").collect())


def products_of(state):
    return sorted((r.page_id, r.url) for r in state.read("structured_products").collect())


def run(spark, run_dir, **options):
    for query in stream_capture_state(read_capture_stream(spark, run_dir + "/in"), run_dir + "/store", run_dir + "/offsets", **options):
        query.awaitTermination()


def changes(spark, run_dir):
    return spark.read.parquet(run_dir + "/store/pages")


EXPECTED = [
    (1, "https://a/1", "failed", 0, "reset"),
    (2, "https://a/2", "success", 200, None),
    (3, "https://b/3", "success", 200, None),
]
PRODUCTS = [(1, "https://a/1"), (2, "https://a/2"), (2, "https://a/2"), (3, "https://b/3")]


def test_stream_over_arriving_files(spark, captures, run_dir):
    state, batch = CrawlState(spark, run_dir + "/state"), None
    for lot in lots(captures):
        lot.write.mode("append").parquet(run_dir + "/in")
        run(spark, run_dir, seed=True)
        for _ in range(2):
            batch = merge_stream(state, run_dir + "/store", NOW, seed=True, batch_id=batch)
    assert spark.conf.get(STATE_STORE) == ROCKS_DB
    assert pages_of(state) == EXPECTED
    assert products_of(state) == PRODUCTS
    assert sorted(r.url for r in stream_products(spark, run_dir + "/store").collect()) == [url for _, url in PRODUCTS]


def test_pages_are_given_out_when_they_change(spark, captures, run_dir):
    many = captures(*[dict(url=f"https://big/{i}", body=LD) for i in range(40)])
    many.write.mode("append").parquet(run_dir + "/in")
    run(spark, run_dir, seed=True)
    assert changes(spark, run_dir).count() == 40
    # One capture of a large host gives out one row, the same captures once more give out none.
    captures(dict(url="https://big/7", status_code=404, status_text="404 Gone", seq=50)).write.mode("append").parquet(run_dir + "/in")
    run(spark, run_dir, seed=True)
    assert changes(spark, run_dir).count() == 41
    run(spark, run_dir, seed=True)
    many.filter("url <> 'https://big/7'").write.mode("append").parquet(run_dir + "/in")
    run(spark, run_dir, seed=True)
    assert changes(spark, run_dir).count() == 41
    pages = {r.url: (r.status_code, r.version) for r in stream_pages(spark, run_dir + "/store").collect()}
    assert pages.pop("https://big/7") == (404, 2) and set(pages.values()) == {(200, 1)}


def test_a_batch_replayed_after_a_crash_changes_nothing(spark, captures, run_dir):
    for lot in lots(captures):
        lot.write.mode("append").parquet(run_dir + "/in")
        run(spark, run_dir, seed=True)
    before = sorted(map(str, changes(spark, run_dir).collect()))
    products = stream_products(spark, run_dir + "/store").count()
    # As if both queries had died after their last batch was written and before it was marked as done.
    for name in ("scraped", "pages"):
        folder = f"{run_dir}/offsets/{name}/commits"
        last = max(int(n) for n in os.listdir(folder) if n.isdigit())
        for file in (f"{last}", f".{last}.crc"):
            shutil.move(f"{folder}/{file}", f"{run_dir}/{name}-{file}")
    run(spark, run_dir, seed=True)
    assert sorted(map(str, changes(spark, run_dir).collect())) == before
    assert stream_products(spark, run_dir + "/store").count() == products


def test_without_seeding_unknown_urls_are_ignored(spark, captures, run_dir):
    known = spark.createDataFrame([("https://a/1", 0), ("https://a/2", 1)], "url string, cand_ord int")
    state = CrawlState(spark, run_dir + "/state")
    state.replace("pages", merges.seed_pages(spark.createDataFrame([], PAGES), known, NOW))
    for lot in lots(captures):
        lot.write.mode("append").parquet(run_dir + "/in")
        run(spark, run_dir, known=state.read("pages"))
    assert sorted(r.url for r in stream_pages(spark, run_dir + "/store").collect()) == ["https://a/1", "https://a/2"]
    merge_stream(state, run_dir + "/store", NOW)
    assert pages_of(state) == EXPECTED[:2]
    assert products_of(state) == PRODUCTS[:3]


def test_a_hot_url_is_collapsed_before_it_moves(spark, captures, run_dir):
    rows = captures(dict(url="https://a/1"), dict(url="https://b/2"))
    hot = spark.range(3000).crossJoin(rows.filter("url = 'https://a/1'")).withColumn("seq", F.col("id")).drop("id")
    hot.withColumn("status_code", F.when(F.col("seq") == 2999, F.lit(503)).otherwise(F.lit(200)).cast("int")).unionByName(rows).write.parquet(run_dir + "/in")
    query = stream_capture_state(read_capture_stream(spark, run_dir + "/in"), run_dir + "/store", run_dir + "/offsets", seed=True)[1]
    query.awaitTermination()
    assert {r.url: r.status_code for r in stream_pages(spark, run_dir + "/store").collect()} == {"https://a/1": 503, "https://b/2": 200}
    assert sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]) == 2
