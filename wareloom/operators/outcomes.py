"""What happened to each scraped page."""

from pyspark.sql import functions as F

from wareloom.fixed_values import FAILED, NOT_DECODED, OUTSIDE_DOMAINS, SCRAPED, SKIPPED, SUCCESS, UNEXPECTED_STATUS
from wareloom.functions.text import empty_to_null


def extract_error(decode_status, content_encoding):
    """Error of a page that could not be read since its encoding is not known; NULL for others."""
    text = F.concat(F.lit(NOT_DECODED), F.coalesce(content_encoding, F.lit("")))
    return F.when(decode_status == "unsupported", text)


def classify_outcomes(fetched, keep=()):
    """Outcome rows from fetch results (url, allowed, fetch_error, status_code, status_text, duration_ms, ...).

    The first rule that applies decides: outside the allowed domains, failed fetch,
    status outside 2xx, failed extraction, success. Failures without a response have
    status 0, not NULL. A page without products is still a success. Columns named in `keep` stay.
    """
    columns = fetched.columns
    unread = F.col("extract_error") if "extract_error" in columns else F.lit(None).cast("string")
    disallowed = ~F.coalesce("allowed", F.lit(False)) if "allowed" in columns else F.lit(False)
    no_fetch = F.col("fetch_error").isNotNull()
    bad_status = ~F.coalesce(F.col("status_code").between(200, 299), F.lit(False))
    zero = F.lit(0).cast("bigint")
    error = (
        F.when(disallowed, F.lit(OUTSIDE_DOMAINS))
        .when(no_fetch, F.col("fetch_error"))
        .when(bad_status, F.concat(F.lit(UNEXPECTED_STATUS), F.coalesce("status_text", F.lit(""))))
        .when(unread.isNotNull(), unread)
    )
    failed = disallowed | no_fetch | bad_status | unread.isNotNull()
    status_code = F.coalesce(F.col("status_code").cast("bigint"), zero)
    return fetched.select(
        "url",
        F.when(failed, F.lit(FAILED)).otherwise(F.lit(SUCCESS)).alias("scrape_status"),
        F.when(disallowed | no_fetch, zero).otherwise(status_code).alias("status_code"),
        F.when(disallowed, zero).otherwise(F.coalesce("duration_ms", zero)).alias("duration_ms"),
        empty_to_null(error).alias("error"),
        F.when(disallowed, F.lit(SKIPPED)).when(failed, F.lit(FAILED)).otherwise(F.lit(SCRAPED)).alias("label"),
        "batch_id",
        "seq",
        *keep,
    )
