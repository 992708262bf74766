"""Names and texts that have to be exactly these for results to agree."""

# Document kinds and the source recorded for declared sitemaps.
INDEX_ROOT = "sitemapindex"
SET_ROOT = "urlset"
ROBOTS_SOURCE = "robots.txt"

# Record and page states, and the labels of the scrape log.
SUCCESS = "success"
FAILED = "failed"
PENDING = "pending"
SCRAPED = "scraped"
SKIPPED = "skipped"

# Stored error texts; the second part of the two-part ones is the document's or the response's.
OUTSIDE_DOMAINS = "URL outside allowed domains"
UNEXPECTED_STATUS = "unexpected status "
FETCH_SITEMAP = "fetch sitemap "
UNSUPPORTED_ROOT = "unsupported root element "
EMPTY_INPUT = "EOF"
CUT_OFF = "unexpected EOF"
NOT_GZIP = "gzip: invalid header"
NOT_DECODED = "unsupported content encoding "

# The script type that is read and the types, in lower case, that count as products.
JSONLD_TYPE = "application/ld+json"
PRODUCT_TYPES = ("product", "https://schema.org/product")
