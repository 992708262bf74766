"""Crawl inputs derived from the supplied tables, for the registered queries.

Every input is computed by Spark from whole tables and grows with them.
"""

import gzip
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from wareloom.schemas import CAPTURES, column_names

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# URL sets list at most this many pages, so no document grows with a busy host.
PAGES_PER_SET = 1000

LASTMOD_START = "2024-01-01"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _captures(df, **columns):
    """Fill up the capture schema with defaults for what is not given."""
    defaults = {
        "final_url": F.col("url"),
        "status_code": F.lit(200),
        "status_text": F.lit("200 OK"),
        "content_type": F.lit("text/html"),
        "content_encoding": F.lit(""),
        "fetch_error": F.lit(None).cast("string"),
        "delay_ms": F.lit(0),
        "duration_ms": F.length("url"),
        "batch_id": F.lit(0),
        "seq": F.lit(0),
        **columns,
    }
    types = {"status_code": "int", "delay_ms": "bigint", "duration_ms": "bigint", "batch_id": "bigint", "seq": "bigint"}
    types["body"] = "binary"
    return df.select(
        *[
            (defaults[name] if name in defaults else F.col(name)).cast(types.get(name, "string")).alias(name)
            for name in column_names(CAPTURES)
        ]
    )


def as_captures(df):
    """Columns of `df` in the order and types of the capture schema."""
    return _captures(df, **{name: F.col(name) for name in column_names(CAPTURES)})


def hosted_pages(spark, sf_dir, *more):
    """Pages with the host and language found in their URL."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        F.regexp_extract("url", "://([^/:?#]+)", 1).alias("host"),
        F.regexp_extract("url", "://[^/]+/([a-z]+)/", 1).alias("lang"),
        *more,
    )


def robots_captures(spark, sf_dir):
    """One robots file per host, declaring one sitemap; `seq` is the host's first page."""
    hosts = hosted_pages(spark, sf_dir).groupBy("host").agg(F.min("page_id").alias("first_page"))
    body = F.concat(
        F.lit("# crawl gently\nCrawl-delay: 4\nSitemap: https://"), F.col("host"), F.lit("/sitemap.xml\n")
    )
    robots = hosts.select(
        F.concat(F.lit("https://"), "host", F.lit("/robots.txt")).alias("url"), body.alias("body"), "first_page"
    )
    return _captures(robots, content_type=F.lit("text/plain"), seq=F.col("first_page"))


def _escaped(col):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def _document(root, entries):
    return F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<{root} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
        F.array_join(F.transform(F.array_sort(entries), lambda e: e["xml"]), "\n"),
        F.lit(f"</{root}>"),
    )


def _entries(place, xml):
    return F.collect_list(F.struct(place.alias("place"), xml.alias("xml")))


def _index_entry(loc):
    return F.concat(F.lit("<sitemap><loc>"), _escaped(loc), F.lit("</loc></sitemap>"))


def sitemap_captures(spark, sf_dir):
    """Host index -> language indexes -> URL sets of at most PAGES_PER_SET pages.

    Host indexes also list themselves (a cycle) and, for host names whose length is
    a multiple of 3, a sitemap that was never captured. Spanish URL sets of hosts
    with an even name length answer 404.
    """
    pages = hosted_pages(spark, sf_dir).withColumn("chunk", F.expr(f"page_id div {PAGES_PER_SET}"))
    base = F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemap"))
    lastmod = F.date_add(F.lit(LASTMOD_START).cast("date"), (F.col("page_id") % 365).cast("int")).cast("string")
    entry = F.concat(
        F.lit("<url><loc>"),
        _escaped(F.col("url")),
        F.lit("</loc>"),
        F.when(F.col("page_id") % 5 == 0, F.lit("")).otherwise(
            F.concat(F.lit("<lastmod>"), lastmod, F.lit("</lastmod>"))
        ),
        F.lit("</url>"),
    )
    sets = pages.groupBy("host", "lang", "chunk").agg(_document("urlset", _entries(F.col("page_id"), entry)).alias("body"))
    lost = (F.col("lang") == "es") & (F.length("host") % 2 == 0)
    set_url = F.concat(base, F.lit("-"), "lang", F.lit("-"), F.col("chunk").cast("string"), F.lit(".xml"))
    set_rows = sets.select(set_url.alias("url"), "body", lost.alias("lost"))

    lang_url = F.concat(base, F.lit("-"), "lang", F.lit(".xml"))
    chunks = pages.select("host", "lang", "chunk").distinct()
    lang_rows = chunks.groupBy("host", "lang").agg(
        _document("sitemapindex", _entries(F.col("chunk"), _index_entry(set_url))).alias("body")
    )
    lang_rows = lang_rows.select(lang_url.alias("url"), "body", F.lit(False).alias("lost"))

    langs = pages.select("host", "lang").distinct()
    listed = langs.select("host", F.col("lang").alias("place"), lang_url.alias("loc")).unionByName(
        langs.select("host", F.explode(F.array(F.lit("~self"), F.lit("~zmissing"))).alias("place"))
        .distinct()
        .filter((F.col("place") == "~self") | (F.length("host") % 3 == 0))
        .withColumn(
            "loc",
            F.when(F.col("place") == "~self", F.concat(base, F.lit(".xml"))).otherwise(
                F.concat(base, F.lit("-missing.xml"))
            ),
        )
    )
    return _sitemap_files(set_rows.unionByName(lang_rows).unionByName(_host_indexes(listed)))


def _host_indexes(listed):
    """Index files of hosts from their entries (host, place, loc)."""
    body = _document("sitemapindex", _entries(F.col("place"), _index_entry(F.col("loc"))))
    url = F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemap.xml"))
    return listed.groupBy("host").agg(body.alias("body")).select(url.alias("url"), "body", F.lit(False).alias("lost"))


def _sitemap_files(rows, batch_id=0):
    return _captures(
        rows,
        status_code=F.when(F.col("lost"), F.lit(404)).otherwise(F.lit(200)),
        status_text=F.when(F.col("lost"), F.lit("404 Not Found")).otherwise(F.lit("200 OK")),
        content_type=F.lit("application/xml"),
        batch_id=F.lit(batch_id),
    )


def _language_entries(spark, sf_dir):
    """Entries (host, lang, loc) of language indexes, and (host, loc) of the host of the page after a host's first."""
    pages = hosted_pages(spark, sf_dir)
    loc = F.concat(F.lit("https://"), "host", F.lit("/sitemap-"), "lang", F.lit(".xml"))
    langs = pages.select("host", "lang").distinct().withColumn("loc", loc)
    after = pages.groupBy("host").agg((F.min("page_id") + 1).alias("page_id"))
    nearby = after.join(pages.select("page_id", F.col("host").alias("other")), "page_id")
    return langs, nearby.select("host", F.concat(F.lit("https://"), "other", F.lit("/sitemap.xml")).alias("loc"))


def crosslinked_sitemaps(spark, sf_dir):
    """Sitemaps in which each host index lists its language indexes and then the index of another host."""
    langs, nearby = _language_entries(spark, sf_dir)
    listed = langs.select("host", F.col("lang").alias("place"), "loc").unionByName(
        nearby.select("host", F.lit("~next").alias("place"), "loc")
    )
    below = sitemap_captures(spark, sf_dir).filter(~F.col("url").endswith("/sitemap.xml"))
    return below.unionByName(_sitemap_files(_host_indexes(listed)))


def recrawled_indexes(spark, sf_dir):
    """Host indexes captured again, changed: by the length of the host's name modulo 3,

    1: the other host comes first, then languages in falling order without the French one;
    2: the file is gone (404). Those of the other hosts are not captured again.
    """
    langs, nearby = _language_entries(spark, sf_dir)
    falling = F.concat(F.lit("b"), F.translate("lang", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"))
    kept = langs.filter(F.col("lang") != "fr").select("host", falling.alias("place"), "loc")
    listed = kept.unionByName(nearby.select("host", F.lit("a").alias("place"), "loc"))
    changed = _host_indexes(listed.filter(F.length("host") % 3 == 1))
    gone = langs.filter(F.length("host") % 3 == 2).select("host").distinct()
    url = F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml"))
    gone = gone.select(url.alias("url"), F.lit("").alias("body"), F.lit(True).alias("lost"))
    return _sitemap_files(changed.unionByName(gone), batch_id=1)


def product_pages(spark, sf_dir):
    """Page HTML with a JSON-LD script made from the part of the same number, counted round.

    By page number: a multiple of ten less one has malformed JSON; of the others,
    every third has a single product, the next one a graph, and the rest no script.
    """
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    # Beyond the number of parts they are used again, so that no page goes without one.
    pages = table(spark, sf_dir, "pages").join(parts, F.col("page_id") % max(1, parts.count()) == F.col("p_partkey"))
    number = F.col("page_id")
    fields = F.concat(
        F.lit('"sku":"'), number.cast("string"), F.lit('", "offers":{"priceCurrency":"EUR","price":'),
        F.round(F.col("p_retailprice") * 100).cast("bigint").cast("string"),
        F.lit('e-2},"name":"'), F.col("p_name"), F.lit(' <b> & co"'),
    )
    single = F.concat(F.lit('{"@type":"Product","@context":"https://schema.org",'), fields, F.lit("}"))
    graph = F.concat(
        F.lit('{"@context":"https://schema.org","@graph":[{"@type":"BreadcrumbList"},{"@type":["Product","Thing"],'),
        fields,
        F.lit("}]}"),
    )
    payload = (
        F.when(number % 10 == 9, F.lit('{"@type":"Product",'))
        .when(number % 3 == 0, single)
        .when(number % 3 == 1, graph)
    )
    script = F.concat(F.lit('<script type="application/ld+json">'), payload, F.lit("</script></head>"))
    html = F.when(payload.isNull(), F.col("html")).otherwise(F.replace("html", F.lit("</head>"), script))
    return _captures(pages.select("page_id", "url", html.alias("body")), seq=F.col("page_id"))


def page_events(spark, sf_dir):
    """Events with the page their user number names, counted round, in event order."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return events.join(pages, F.col("user_id") % max(1, pages.count()) == F.col("page_id")).select(
        "event_id", "ts", "event_type", "value", "page_id", "url"
    )


def fetch_results(events):
    """Fetch results of page events: errors are status 500, signups lost connections."""
    kind = F.col("event_type")
    return events.select(
        "url",
        F.lit(True).alias("allowed"),
        F.when(kind == "signup", F.lit("connection reset")).alias("fetch_error"),
        F.when(kind == "error", F.lit(500)).when(kind == "signup", F.lit(0)).otherwise(F.lit(200)).alias("status_code"),
        F.when(kind == "error", F.lit("500 Internal Server Error")).otherwise(F.lit("200 OK")).alias("status_text"),
        F.floor("value").cast("bigint").alias("duration_ms"),
        F.expr("event_id div 1000").alias("batch_id"),
        F.col("event_id").alias("seq"),
    )


def upsert_batches(events):
    """Page upserts of page events; views carry no lastmod."""
    return events.select(
        F.col("url").alias("loc"),
        F.when(F.col("event_type") != "view", F.date_format("ts", "yyyy-MM-dd")).alias("lastmod"),
        F.col("event_type").alias("source_sitemap"),
        F.expr("event_id div 1000").alias("batch_id"),
        F.col("event_id").alias("seq"),
    )


def sitemap_batches(events):
    """Sitemap records of page events; errors are failed records without a type."""
    failed = F.col("event_type") == "error"
    return events.select(
        F.col("url").alias("loc"),
        F.col("event_type").alias("discovered_from"),
        F.when(failed, F.lit("failed")).otherwise(F.lit("success")).alias("status"),
        F.when(~failed, F.lit("urlset")).alias("type"),
        F.when(failed, F.lit("boom")).alias("error"),
        F.lit(0).cast("bigint").alias("delay_ms"),
        F.floor("value").cast("bigint").alias("duration_ms"),
        F.expr("event_id div 1000").alias("batch_id"),
        F.col("event_id").alias("seq"),
    )


def _raw_deflate(data):
    packer = zlib.compressobj(wbits=-15)
    return packer.compress(data) + packer.flush()


_SLICE_BYTES = 8 << 20


def _packed(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Bodies, the first column, packed by the kinds in each of the other columns, in arrays of bounded size."""
    packers = {"gzip": lambda b: gzip.compress(b, mtime=0), "zlib": zlib.compress, "raw": _raw_deflate}
    for bodies, *kinds in batches:
        packed, size = [], 0
        for body, *forms in zip(bodies, *kinds):
            body = body.as_py()
            for form in forms:
                body = packers.get(form.as_py(), bytes)(body) if body is not None else None
            packed.append(body)
            size += len(body or b"")
            if size >= _SLICE_BYTES:
                yield pa.array(packed, pa.binary())
                packed, size = [], 0
        if packed:
            yield pa.array(packed, pa.binary())
        # Nothing of this batch is kept while the next one is read.
        del bodies, kinds, packed
        pa.default_memory_pool().release_unused()


def packed_captures(spark, sf_dir):
    """Page HTML captures in all transport forms, chosen by page number.

    gzip, zlib and raw deflate under their header, plain under a gzip header, plain
    without header, and gzip applied after deflate.
    """
    names = F.array(*[F.lit(n) for n in ("gzip", "zlib", "raw", "none", "none", "raw")])
    headers = F.array(*[F.lit(n) for n in ("gzip", "deflate", "Deflate", "gzip", "", "deflate, GZIP")])
    pages = table(spark, sf_dir, "pages").withColumn("form", (F.col("page_id") % 6).cast("int") + 1)
    pack = F.arrow_udf(_packed, "binary")
    second = F.when(F.col("form") == 6, F.lit("gzip")).otherwise(F.lit("none"))
    packed = pages.withColumn("body", pack(F.col("html").cast("binary"), F.element_at(names, F.col("form")), second))
    return _captures(packed, content_encoding=F.element_at(headers, F.col("form")), seq=F.col("page_id"))


def packed_sitemaps(spark, sf_dir):
    """The sitemap documents as gzip files, announced by content type or by file name."""
    plain = sitemap_captures(spark, sf_dir)
    pack = F.arrow_udf(_packed, "binary")
    by_name = F.length("url") % 2 == 0
    return plain.withColumns(
        {
            "body": pack(F.col("body").cast("binary"), F.lit("gzip")),
            "url": F.when(by_name, F.concat("url", F.lit(".GZ?v=1"))).otherwise(F.col("url")),
            "content_type": F.when(by_name, F.lit("application/xml")).otherwise(F.lit("Application/X-GZip")),
        }
    )
