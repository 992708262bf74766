"""State merges: a batch is collapsed to one row per URL, then joined with the old state.

Collapsing aggregates map-side, so a URL repeated in a large share of the batch never
gathers in one task, and the joins that follow have one row per URL on both sides.
"""

from pyspark.sql import functions as F

from wareloom.fixed_values import PENDING
from wareloom.functions.text import empty_to_null
from wareloom.functions.urls import state_host
from wareloom.operators.joins import lookup_join, missing_rows
from wareloom.operators.ordering import with_positions
from wareloom.schemas import PAGES, SITEMAPS, column_names
from wareloom.session import RunTables

ORDER = ("batch_id", "seq")


def _order(order):
    return F.struct(*order)


def next_id(state, id_column):
    """Largest id in use; a single value."""
    return state.agg(F.coalesce(F.max(id_column), F.lit(0))).first()[0]


def assign_ids(rows, order, id_column, start=0, tables=None):
    """Number rows from `start + 1` in the order of their first insert."""
    placed = with_positions(rows, order, id_column, tables=tables)
    return placed.withColumn(id_column, F.col(id_column) + F.lit(start))


def _merge(state, latest, id_column, updates, inserts, columns, id_start, tables):
    """Old rows with `updates` applied where the batch has their URL, plus new rows.

    `latest` has one row per URL and a `first_order` column; both update and insert
    expressions see batch columns under a `new_` prefix.
    """
    latest = tables.write(latest, "latest")
    fresh = missing_rows(latest, state, "url")
    start = next_id(state, id_column) if id_start is None else id_start
    numbered = assign_ids(fresh, ["first_order"], id_column, start, tables)
    merged = state.join(latest.withColumn("_hit", F.lit(True)), "url", "left")
    kept = merged.select(
        *[F.when(F.col("_hit"), updates[c]).otherwise(F.col(c)).alias(c) if c in updates else F.col(c) for c in columns]
    )
    added = numbered.select(*[inserts[c].alias(c) if c in inserts else F.col(c) for c in columns])
    return kept.unionByName(added)


def upsert_sitemaps(sitemaps, records, as_of, order=ORDER, id_start=None, tables=None):
    """Merge sitemap records by URL: the last record wins in every column, NULLs included.

    `created_at` and the id stay; `updated_at` becomes `as_of`.
    """
    tables = tables or RunTables(sitemaps.sparkSession, "upsert-sitemaps")
    values = ("discovered_from", "status", "type", "error", "delay_ms", "duration_ms")
    incoming = records.select(
        F.col("loc").alias("url"),
        "discovered_from",
        "status",
        empty_to_null(F.col("type")).alias("type"),
        empty_to_null(F.col("error")).alias("error"),
        "delay_ms",
        "duration_ms",
        _order(order).alias("_order"),
    )
    latest = (
        incoming.groupBy("url")
        .agg(F.max_by(F.struct(*values), "_order").alias("last"), F.min("_order").alias("first_order"))
        .select("url", "first_order", *[F.col(f"last.{name}").alias(f"new_{name}") for name in values])
    )
    new = {name: F.col(f"new_{name}") for name in values}
    now = F.lit(as_of).cast("timestamp")
    return _merge(
        sitemaps,
        latest,
        "sitemap_id",
        {**new, "updated_at": now},
        {**new, "created_at": now, "updated_at": now, "host": state_host(F.col("url"))},
        column_names(SITEMAPS),
        id_start,
        tables,
    )


def upsert_pages(pages, batch, as_of, order=ORDER, id_start=None, tables=None):
    """Merge page URLs (loc, lastmod, source_sitemap) into the pages table.

    `source_sitemap` takes the last value even when that is NULL, `lastmod` the last
    one that is not. Scrape columns stay; new pages start out pending.
    """
    tables = tables or RunTables(pages.sparkSession, "upsert-pages")
    incoming = batch.select(
        F.col("loc").alias("url"),
        empty_to_null(F.col("lastmod")).alias("lastmod"),
        empty_to_null(F.col("source_sitemap")).alias("source_sitemap"),
        _order(order).alias("_order"),
    )
    dated = F.when(F.col("lastmod").isNotNull(), F.col("_order"))
    latest = incoming.groupBy("url").agg(
        F.max_by(F.struct("source_sitemap"), "_order")["source_sitemap"].alias("new_source_sitemap"),
        F.max_by("lastmod", dated).alias("new_lastmod"),
        F.min("_order").alias("first_order"),
    )
    now = F.lit(as_of).cast("timestamp")
    return _merge(
        pages,
        latest,
        "page_id",
        {
            "source_sitemap": F.col("new_source_sitemap"),
            "lastmod": F.coalesce("new_lastmod", "lastmod"),
            "updated_at": now,
        },
        {
            "source_sitemap": F.col("new_source_sitemap"),
            "lastmod": F.col("new_lastmod"),
            "scrape_status": F.lit(PENDING),
            "status_code": F.lit(None).cast("bigint"),
            "duration_ms": F.lit(None).cast("bigint"),
            "error": F.lit(None).cast("string"),
            "visited_at": F.lit(None).cast("timestamp"),
            "created_at": now,
            "updated_at": now,
            "host": state_host(F.col("url")),
        },
        column_names(PAGES),
        id_start,
        tables,
    )


def seed_pages(pages, candidates, as_of, order=("cand_ord",), id_start=None, tables=None):
    """Upsert bare URLs; a known page loses its `source_sitemap` and keeps its `lastmod`."""
    bare = candidates.withColumnRenamed("url", "loc").withColumns(
        {"lastmod": F.lit(None).cast("string"), "source_sitemap": F.lit(None).cast("string")}
    )
    return upsert_pages(pages, bare, as_of, order, id_start, tables)


def apply_outcomes(pages, outcomes, as_of, order=ORDER, tables=None):
    """Write scrape outcomes onto pages by URL; the last outcome wins, unknown URLs do nothing.

    Failures count as visits too, so they are not tried again on resume. The collapsed
    outcomes are stored first: their size is then known when the join is planned, and
    a small batch does not shuffle the pages.
    """
    tables = tables or RunTables(pages.sparkSession, "outcomes")
    values = ("scrape_status", "status_code", "duration_ms", "error")
    latest = (
        outcomes.groupBy("url")
        .agg(F.max_by(F.struct(*values), _order(order)).alias("last"))
        .select("url", F.lit(True).alias("_hit"), *[F.col(f"last.{name}").alias(f"new_{name}") for name in values])
    )
    latest = tables.write(latest, "latest-outcomes")
    now = F.lit(as_of).cast("timestamp")
    updates = {name: F.col(f"new_{name}") for name in values}
    updates.update(visited_at=now, updated_at=now)
    merged = pages.join(latest, "url", "left")
    return merged.select(
        *[
            F.when(F.col("_hit"), updates[c]).otherwise(F.col(c)).alias(c) if c in updates else F.col(c)
            for c in column_names(PAGES)
        ]
    )


def products_with_ids(products, pages, as_of, how="inner"):
    """Products of known pages with their page id; products of unknown URLs are left out.

    With `how="left"` these stay, without page id and host. Rows are appended as they are: scraping
    a page again adds its products again.
    """
    known = pages.select("url", "page_id", "host")
    joined = lookup_join(products, known, "url", how)
    return joined.select(
        "page_id",
        "url",
        F.col("script_ord").cast("int"),
        F.col("product_ord").cast("int"),
        "raw_json",
        F.lit(as_of).cast("timestamp").alias("scraped_at"),
        "host",
        "batch_id",
    )
