"""Column contracts of the tables the library reads and writes."""

CAPTURES = (
    "url string, final_url string, status_code int, status_text string, content_type string, "
    "content_encoding string, body binary, fetch_error string, delay_ms bigint, duration_ms bigint, "
    "batch_id bigint, seq bigint"
)

PAGE_LIST = "loc string, lastmod string, source_sitemap string"

# `seq` orders rows inside one resolve run: depth, start position, then the entry
# position taken at each hop. Arrays compare element by element, so sorting by it
# gives breadth-first order without numbering rows globally.
SITEMAP_RECORDS = (
    "loc string, discovered_from string, status string, type string, error string, delay_ms bigint, "
    "duration_ms bigint, depth int, batch_id bigint, seq array<bigint>"
)

RESOLVED_PAGES = "loc string, lastmod string, source_sitemap string, batch_id bigint, seq array<bigint>"

OUTCOMES = (
    "url string, scrape_status string, status_code bigint, duration_ms bigint, error string, label string, "
    "batch_id bigint, seq bigint"
)

PAGES = (
    "page_id bigint, url string, source_sitemap string, lastmod string, scrape_status string, "
    "status_code bigint, duration_ms bigint, error string, visited_at timestamp, created_at timestamp, "
    "updated_at timestamp, host string"
)

SITEMAPS = (
    "sitemap_id bigint, url string, discovered_from string, status string, type string, error string, "
    "delay_ms bigint, duration_ms bigint, created_at timestamp, updated_at timestamp, host string"
)

STRUCTURED_PRODUCTS = (
    "page_id bigint, url string, script_ord int, product_ord int, raw_json string, scraped_at timestamp, "
    "host string, batch_id bigint"
)


def column_names(ddl):
    """Names in a schema string, in order."""
    depth = 0
    names, token = [], ""
    for char in ddl + ",":
        depth += char == "<"
        depth -= char == ">"
        if char == "," and depth == 0:
            names.append(token.split()[0])
            token = ""
        else:
            token += char
    return names
