"""Counts, summaries and logs over crawl state."""

from functools import reduce

from pyspark.sql import functions as F

from wareloom.fixed_values import FAILED, INDEX_ROOT, SET_ROOT, SUCCESS
from wareloom.operators.ordering import with_positions


def count_pages(pages):
    return pages.agg(F.count("*").alias("pages"))


def count_pending(pages):
    return pages.agg(F.count_if(F.col("visited_at").isNull()).alias("pending"))


def count_products(products):
    return products.agg(F.count("*").alias("products"))


def _one_row(*parts):
    """Add up one-row count tables that each fill some of the columns."""
    names = [name for part in parts for name in part.columns]
    united = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)
    return united.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names])


def record_counts():
    """Aggregates over sitemap records for a summary."""
    done = F.col("status") == SUCCESS
    return [
        F.count("*").alias("sitemaps_attempted"),
        F.count_if(done).alias("sitemaps_succeeded"),
        F.count_if(~done).alias("sitemaps_failed"),
        F.count_if(done & (F.col("type") == INDEX_ROOT)).alias("sitemap_indexes"),
        F.count_if(done & (F.col("type") == SET_ROOT)).alias("url_sets"),
    ]


def page_counts():
    return [F.count("*").alias("final_urls")]


def outcome_counts():
    """Aggregates over scrape outcomes for a summary."""
    return [F.count("*").alias("pages_scraped"), F.count_if(F.col("scrape_status") == FAILED).alias("failures")]


def summary_row(spark, counts):
    """One row of counters that the jobs of a run have taken on their way."""
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{name} bigint" for name in counts))


def resolve_summary(records, pages):
    """One row of counters; `final_urls` counts repeats, `failed_pages` is always 0."""
    return _one_row(records.agg(*record_counts()), pages.agg(*page_counts())).withColumn("failed_pages", F.lit(0).cast("bigint"))


def slowest_sitemaps(records, k=5):
    """The k slowest sitemaps; equal durations are ordered by location."""
    return records.select("duration_ms", "loc").orderBy(F.desc("duration_ms"), "loc").limit(k)


def failed_sitemaps(records, k=5):
    """The first k failed sitemaps in record order."""
    failed = records.filter(F.col("status") == FAILED)
    return failed.orderBy("batch_id", "seq").select("loc", "error").limit(k)


def scrape_summary(outcomes, products):
    """Pages attempted, products stored in total, failures."""
    return _one_row(outcomes.agg(*outcome_counts()), products.agg(F.count("*").alias("stored_products")))


def scrape_log(outcomes):
    """One line per outcome: label, position, total, status, duration, url, error and the printed text."""
    rows = outcomes.select("label", "status_code", "duration_ms", "url", "error", "batch_id", "seq")
    placed = with_positions(rows, ["batch_id", "seq"], "position", total="total")
    line = F.concat_ws(
        "\t",
        F.format_string("[%s]", "label"),
        F.format_string("[%d/%d]", "position", "total"),
        F.col("status_code").cast("string"),
        F.format_string("%dms", "duration_ms"),
        "url",
        "error",
    )
    return placed.select("label", "position", "total", "status_code", "duration_ms", "url", "error", line.alias("line"))
