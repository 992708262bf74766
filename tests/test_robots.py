from wareloom.operators.robots import extract_robots_sitemaps

CASES = {
    "two-declarations": (
        "siteMAP: https://lamps.test/all.xml\nUser-agent: bot\nAllow: /\n\nSitemap: https://lamps.test/new.xml.gz",
        ["https://lamps.test/all.xml", "https://lamps.test/new.xml.gz"],
    ),
    "unicode-white-space": ("　SITEMAP\u0085:\t https://a/1 \r\n", ["https://a/1"]),
    "byte-order-mark-stays": ("﻿Sitemap: https://a/1\nSitemap: https://a/2", ["https://a/2"]),
    "comment-stays": ("Sitemap: https://a/1 # main", ["https://a/1 # main"]),
    "commented-out": ("# Sitemap: https://a/1\n#Sitemap: https://a/2", []),
    "lone-returns-are-one-line": ("User-agent: *\rSitemap: https://a/1", []),
    "value-with-return-inside": ("Sitemap: https://a/1\rx", ["https://a/1\rx"]),
    "empty-value": ("Sitemap:\nSitemap:   \nSitemap", []),
    "repeats-kept": ("Sitemap: u\nSitemap: u", ["u", "u"]),
    "long-s-folds": ("ſitemap: u", ["u"]),
    "other-key": ("Sitemaps: u\nXSitemap: v\nSite map: w", []),
    "colon-in-value": ("sitemap:https://a:8080/x:y", ["https://a:8080/x:y"]),
}


def test_declarations(captures):
    rows = captures(*[dict(url=name, body=text) for name, (text, _) in CASES.items()])
    found = {name: [] for name in CASES}
    for row in extract_robots_sitemaps(rows).orderBy("robots_url", "line_no").collect():
        found[row.robots_url].append(row.sitemap_url)
    assert found == {name: expected for name, (_, expected) in CASES.items()}


def test_only_successful_captures(captures):
    rows = captures(
        dict(url="a", body="Sitemap: x", status_code=404),
        dict(url="b", body="Sitemap: x", fetch_error="timeout"),
        dict(url="c", body="Sitemap: x", status_code=204),
    )
    assert [r.robots_url for r in extract_robots_sitemaps(rows).collect()] == ["c"]
