"""Structured Streaming jobs that keep page state up to date as captures arrive.

Two queries in a row, each exactly once: the first reads every body once and appends outcomes and
products; the second keeps the last outcome of each URL in the state store and appends a row for each
page whose outcome has changed. Both write through Spark's file sink, so a replayed batch adds nothing.
"""

import sys

from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from wareloom.operators.decode import decode_captures
from wareloom.operators.joins import known_keys, missing_rows
from wareloom.operators.merges import apply_outcomes, products_with_ids, seed_pages
from wareloom.operators.outcomes import classify_outcomes, extract_error
from wareloom.operators.products import explode_products, with_products
from wareloom.operators.url_filter import possible_keys
from wareloom.schemas import CAPTURES, OUTCOMES
from wareloom.session import RunTables, make_folder, path_exists

# Workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_OUTCOME = "scrape_status string, status_code bigint, duration_ms bigint, error string, batch_id bigint, seq bigint"
SCRAPED = OUTCOMES + ", products array<struct<script_ord:int,product_ord:int,raw_json:string>>"
# `version` counts the changes of a URL's outcome; `first` is the order of its first capture.
PAGE_CHANGES = f"url string, {_OUTCOME}, version bigint, first_batch_id bigint, first_seq bigint"
_VALUES = [part.split()[0] for part in PAGE_CHANGES.split(", ")][1:]

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_capture_stream(spark, path, files_per_trigger=None):
    """Capture files as a stream."""
    reader = spark.readStream.schema(CAPTURES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def unseen_urls(arriving, pages, known=None, tables=None):
    """Arriving (url, cand_ord) not stored yet, each URL once.

    The stored pages are the memory: a watermark would forget old URLs. With the filter `known` of the
    stored URLs only those that it may hold are looked for among the pages; if there are none, the
    pages are not read at all.
    """
    first = arriving.groupBy("url").agg(F.min("cand_ord").alias("cand_ord"))
    if known is None:
        return missing_rows(first, pages, "url")
    tables = tables or RunTables(arriving.sparkSession, "unseen")
    first = tables.write(first, "arriving")
    possible = tables.write(possible_keys(first, known), "possible")
    if possible.isEmpty():
        return first
    return first.join(known_keys(possible, pages, "url"), "url", "left_anti")


def scrape_captures(captures):
    """Outcome and products of each capture, map-only; bodies are read once and left behind."""
    scraped = with_products(decode_captures(captures))
    zero = F.lit(0).cast("bigint")
    fetched = scraped.withColumns(
        {
            "extract_error": extract_error(F.col("decode_status"), F.col("content_encoding")),
            "batch_id": F.coalesce("batch_id", zero),
            "seq": F.coalesce("seq", zero),
        }
    )
    return classify_outcomes(fetched, keep=["products"])


class PageState(StatefulProcessor):
    """Keeps the last outcome of a URL and gives out a row when it changes.

    The last capture of the newest batch counts. Without `seed` only URLs that are known, by the
    initial state, have one.
    """

    def __init__(self, seed):
        self.seed = seed

    def init(self, handle):
        self.page = handle.getValueState("page", PAGE_CHANGES.split(", ", 1)[1])

    def handleInitialState(self, key, initialState, timerValues):
        self.page.update(tuple(initialState[name] for name in _VALUES))

    def handleInputRows(self, key, rows, timerValues):
        last = max(rows, key=lambda row: (row.batch_id, row.seq))
        outcome = (last.scrape_status, last.status_code, last.duration_ms, last.error, last.batch_id, last.seq)
        known = self.page.get()
        if known is None and not self.seed:
            return
        if known is not None and tuple(known)[: len(outcome)] == outcome:
            return
        version, first = (known[-3] + 1, tuple(known)[-2:]) if known is not None else (1, (last.batch_id, last.seq))
        new = (*outcome, version, *first)
        self.page.update(new)
        yield Row(url=key[0], **dict(zip(_VALUES, new)))


def _last_of_batch(frames):
    """Of the outcomes of a URL in one Arrow batch only the last; keeps a hot URL from moving row by row."""
    for rows in frames:
        yield rows.sort_values(["batch_id", "seq"], kind="stable").drop_duplicates("url", keep="last")


def known_pages(pages):
    """Stored pages as initial state of a stream, without any change to give out.

    Written apart, as the stateful operator does not come to terms with a bucketed table.
    """
    zero = F.lit(0).cast("bigint")
    rows = pages.select("url", "scrape_status", "status_code", "duration_ms", "error")
    return RunTables(pages.sparkSession, "known").write(rows.withColumns({name: zero for name in _VALUES[4:]}), "pages")


def page_changes(scraped, known=None, seed=False):
    """Rows of PAGE_CHANGES from a stream of outcomes, by keyed state in the state store."""
    narrow = scraped.select("url", *[name for name in _VALUES if name in OUTCOMES])
    last = narrow.mapInPandas(_last_of_batch, f"url string, {_OUTCOME}")
    initial = known_pages(known).groupBy("url") if known is not None else None
    return last.groupBy("url").transformWithState(PageState(seed), PAGE_CHANGES, "append", "none", initialState=initial)


def stream_capture_state(captures, store, checkpoint, known=None, seed=False, **trigger):
    """Start the two queries that bring arriving captures into `store`; returns both.

    `known` are stored pages, read once when the stream first starts. With `seed`, URLs never seen
    before become pages too. With the default trigger, all that has arrived is processed and the
    queries end; wait for both in order.
    """
    spark = captures.sparkSession
    spark.conf.set(STATE_STORE, ROCKS_DB)
    make_folder(spark, f"{store}/scraped")
    trigger = trigger or {"availableNow": True}

    def start(rows, name):
        writer = rows.writeStream.format("parquet").option("checkpointLocation", f"{checkpoint}/{name}")
        return writer.option("path", f"{store}/{name}").trigger(**trigger).start()

    scraping = start(scrape_captures(captures), "scraped")
    if "availableNow" in trigger:
        scraping.awaitTermination()
    arriving = spark.readStream.schema(SCRAPED).parquet(f"{store}/scraped")
    known = None if path_exists(spark, f"{checkpoint}/pages/commits/0") else known
    return scraping, start(page_changes(arriving, known, seed), "pages")


def stream_pages(spark, store):
    """The last outcome of each page that a stream has seen."""
    changes = spark.read.schema(PAGE_CHANGES).parquet(f"{store}/pages")
    last = changes.groupBy("url").agg(F.max_by(F.struct(*_VALUES), "version").alias("last"))
    return last.select("url", "last.*")


def stream_products(spark, store):
    """Products of all captures that a stream has seen."""
    return explode_products(spark.read.schema(SCRAPED).parquet(f"{store}/scraped"))


def merge_stream(state, store, as_of, seed=False, batch_id=None):
    """Bring what a stream has stored so far into `state`; returns the id of its products.

    With `seed`, pages unknown to the state are added, in the order of their first capture. Merging
    again under the same `batch_id` replaces the stream's products and sets the same outcomes again.
    """
    batch_id = state.next_run() if batch_id is None else batch_id
    tables = RunTables(state.spark, "merge-stream")
    outcomes = tables.write(stream_pages(state.spark, store), "outcomes")
    pages = state.read("pages")
    if seed:
        place = F.struct("first_batch_id", "first_seq", "url")
        fresh = unseen_urls(outcomes.select("url", place.alias("cand_ord")), pages, state.url_filter("pages"), tables)
        pages = tables.write(seed_pages(pages, tables.write(fresh, "fresh"), as_of, tables=tables), "seeded")
    products = stream_products(state.spark, store).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    state.append_products(products_with_ids(products, pages, as_of))
    state.replace("pages", apply_outcomes(pages, outcomes, as_of, tables=tables))
    return batch_id
