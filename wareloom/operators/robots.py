"""Sitemap declarations in robots files."""

from pyspark.sql import functions as F

from wareloom.fixed_values import FAILED, NOT_DECODED, ROBOTS_SOURCE, UNEXPECTED_STATUS
from wareloom.functions.text import body_text

# A line up to its first colon is the key; both sides lose Unicode white space.
_DECLARATION = r"(?isU)^\s*+sitemap\s*+:\s*+(.*\S)"


def extract_robots_sitemaps(captures):
    """(robots_url, line_no, sitemap_url, batch_id, seq) of every declaration in 2xx captures.

    File order and repeats are kept; comments after a value stay part of it.
    """
    lines = captures.filter(F.col("fetch_error").isNull() & F.col("status_code").between(200, 299)).select(
        F.col("url").alias("robots_url"),
        "batch_id",
        "seq",
        F.posexplode(F.split(body_text(F.col("body")), "\n")).alias("line_no", "line"),
    )
    declared = lines.select(
        "robots_url", "line_no", F.regexp_extract("line", _DECLARATION, 1).alias("sitemap_url"), "batch_id", "seq"
    )
    return declared.filter(F.col("sitemap_url") != "")


def failed_robots(captures, batch_id=0):
    """Failed records, shaped like those of sitemaps, of robots files that could not be read."""
    bad_status = ~F.coalesce(F.col("status_code").between(200, 299), F.lit(False))
    error = F.coalesce(
        F.col("fetch_error"),
        F.when(bad_status, F.concat(F.lit(UNEXPECTED_STATUS), F.coalesce("status_text", F.lit("")))),
    )
    if "decode_status" in captures.columns:
        undecoded = F.concat(F.lit(NOT_DECODED), F.coalesce("content_encoding", F.lit("")))
        error = F.coalesce(error, F.when(F.col("decode_status") == "unsupported", undecoded))
    return captures.withColumn("_error", error).filter(F.col("_error").isNotNull()).select(
        F.col("url").alias("loc"),
        F.lit(ROBOTS_SOURCE).alias("discovered_from"),
        F.lit(FAILED).alias("status"),
        F.lit(None).cast("string").alias("type"),
        F.col("_error").alias("error"),
        F.coalesce("delay_ms", F.lit(0).cast("bigint")).cast("bigint").alias("delay_ms"),
        F.coalesce("duration_ms", F.lit(0).cast("bigint")).cast("bigint").alias("duration_ms"),
        F.lit(-1).alias("depth"),
        F.lit(batch_id).cast("bigint").alias("batch_id"),
        F.array(F.lit(-1).cast("bigint"), F.col("batch_id"), F.col("seq")).alias("seq"),
    )
