"""Which pages come next: pending pages, candidates, slices and allowed domains."""

from pyspark.sql import functions as F

from wareloom.functions.urls import is_bad_url, url_host
from wareloom.operators.joins import lookup_join, small_or_lookup_join
from wareloom.operators.ordering import slice_ordered
from wareloom.operators.url_filter import possible_keys


def pending_pages(pages, limit=0, offset=0):
    """Unvisited pages in id order; limit 0 means all, the offset applies either way."""
    return slice_ordered(pages.filter(F.col("visited_at").isNull()), ["page_id"], offset, limit)


def pending_from_candidates(candidates, pages, limit=0, known=None):
    """Candidates (url, cand_ord) that are known and unvisited, order and repeats kept.

    With the filter `known` of the stored URLs, candidates that are surely not stored drop out first.
    """
    if known is not None:
        candidates = candidates.join(possible_keys(candidates, known), "url", "left_semi")
    unvisited = pages.filter(F.col("visited_at").isNull()).select("url", "page_id")
    return slice_ordered(lookup_join(candidates, unvisited, "url"), ["cand_ord"], 0, limit)


def page_by_url(pages, url):
    """The page with this URL, as at most one row."""
    return pages.filter(F.col("url") == url)


def pages_by_url(pages, urls):
    """Batched form of `page_by_url` for a table of URLs, repeated ones included."""
    return pages.join(urls.select("url"), "url", "left_semi")


def slice_candidates(candidates, skip=0, limit=0):
    """Skip, then limit, in candidate order; skipping everything is an error."""
    if skip > 0:
        total = candidates.count()
        if skip >= total:
            raise ValueError(f"cannot skip {skip} of {total} candidates: nothing would be left")
    return slice_ordered(candidates, ["cand_ord"], skip, limit)


def allowed_domains(candidates):
    """Distinct hosts (host, first_ord) by first appearance.

    Raises when a URL cannot be parsed or when no URL has a host. The counts are
    taken in one aggregation before any result is returned.
    """
    hosts = candidates.select(url_host(F.col("url")).alias("host"), is_bad_url(F.col("url")).alias("bad"), "cand_ord")
    bad, named = hosts.agg(F.count_if("bad"), F.count_if(F.col("host") != "")).first()
    if bad:
        raise ValueError(f"{bad} page URL(s) cannot be parsed")
    if not named:
        raise ValueError("no page URL has a host")
    return (
        hosts.filter(F.col("host") != "")
        .groupBy("host")
        .agg(F.min("cand_ord").alias("first_ord"))
        .orderBy("first_ord")
    )


def filter_allowed(rows, domains, tables=None):
    """Add `allowed`: the row's host is one of `domains`.

    Domains are few as a rule and then broadcast after their number has been
    checked; otherwise hosts holding a large share of the rows are salted.
    """
    known = domains.select(F.col("host").alias("_host"), F.lit(True).alias("_known")).distinct()
    hosted = rows.withColumn("_host", F.when(~is_bad_url(F.col("url")), url_host(F.col("url"))))
    flagged = small_or_lookup_join(hosted, known, "_host", "left", tables=tables)
    return flagged.withColumn("allowed", F.coalesce("_known", F.lit(False))).drop("_host", "_known")
