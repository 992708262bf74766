import pytest
from pyspark.sql import functions as F

from wareloom.operators import sitemaps
from wareloom.operators.sitemaps import parse_sitemaps, sitemap_children, sitemap_pages

HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
SET, OK = "<urlset>%s</urlset>", "success"

# name: (body, status, type, page locations)
DOCUMENTS = {
    "plain": (SET % "<url><loc>a</loc></url>", OK, "urlset", ["a"]),
    "namespace": ('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>a</loc></url></urlset>', OK, "urlset", ["a"]),
    "prefix": ('<s:urlset xmlns:s="x"><s:url><s:loc>a</s:loc></s:url></s:urlset>', OK, "urlset", ["a"]),
    "blanks-stay": (SET % "<url><loc> a \n</loc></url>", OK, "urlset", [" a \n"]),
    "entities-and-cdata": (SET % "<url><loc>a?x=1&amp;y=2</loc></url><url><loc><![CDATA[b&c]]></loc></url>", OK, "urlset", ["a?x=1&y=2", "b&c"]),
    "empty-locations": (SET % "<url><loc></loc></url><url><loc/></url><url/><url><loc>z</loc></url>", OK, "urlset", ["z"]),
    "last-location-wins": (SET % "<url><loc>a</loc><loc>b</loc></url>", OK, "urlset", ["b"]),
    "nested-markup": (SET % "<url><loc>a<b>c</b>d</loc></url>", OK, "urlset", ["ad"]),
    "attributes": (SET % '<url id="1"><loc x="y">a</loc></url>', OK, "urlset", ["a"]),
    "other-case": (SET % "<URL><loc>a</loc></URL><url><LOC>b</LOC><loc>c</loc></url>", OK, "urlset", ["c"]),
    "too-deep": (SET % "<group><url><loc>a</loc></url></group>", OK, "urlset", []),
    "single-empty": ("<urlset/>", OK, "urlset", []),
    "doctype": ('<!DOCTYPE urlset SYSTEM "x.dtd">' + SET % "<url><loc>a</loc></url>", OK, "urlset", ["a"]),
    "trailing-garbage": (SET % "<url><loc>a</loc></url>" + "<<<", OK, "urlset", ["a"]),
    "blank-before-declaration": (" \n" + HEAD + SET % "<url><loc>a</loc></url>", OK, "urlset", ["a"]),
    "byte-order-mark": ("﻿" + HEAD + SET % "<url><loc>a</loc></url>", OK, "urlset", ["a"]),
    "comments": (HEAD + "<!-- <html> -->" * 2000 + SET % "<!-- x --><url><loc>a<!-- y -->b</loc></url>", OK, "urlset", ["ab"]),
    "stray-urls-in-index": ("<sitemapindex><url><loc>a</loc></url><sitemap><loc>s</loc></sitemap></sitemapindex>", OK, "sitemapindex", []),
    "other-root": ("<html><body/></html>", "failed", None, []),
    "root-case": ("<URLSET><url><loc>a</loc></url></URLSET>", "failed", None, []),
    "empty": ("", "failed", None, []),
    "text": ("not xml", "failed", None, []),
    "cut-off": ("<urlset><url><loc>a</loc></url>", "failed", None, []),
    "bare-ampersand": (SET % "<url><loc>a?x&y</loc></url>", "failed", None, []),
    "own-entity": ('<!DOCTYPE urlset [<!ENTITY e "v">]>' + SET % "<url><loc>&e;</loc></url>", "failed", None, []),
    "latin-declared": ('<?xml version="1.0" encoding="ISO-8859-1"?>' + SET % "<url><loc>a</loc></url>", "failed", None, []),
    "lower-case-utf8": ('<?xml version="1.0" encoding="utf-8"?>' + SET % "<url><loc>a</loc></url>", OK, "urlset", ["a"]),
    "xml-1.1": ('<?xml version="1.1"?>' + SET % "<url><loc>a</loc></url>", "failed", None, []),
    "invalid-utf8": (b"<urlset><url><loc>a\xff</loc></url></urlset>", "failed", None, []),
}


@pytest.fixture
def docs(captures):
    return parse_sitemaps(captures(*[dict(url=name, body=d[0]) for name, d in DOCUMENTS.items()]))


def test_documents(docs):
    got = {r.url: (r.status, r.type) for r in docs.collect()}
    assert got == {name: d[1:3] for name, d in DOCUMENTS.items()}


def test_pages(docs):
    found = {name: [] for name in DOCUMENTS}
    for row in sitemap_pages(docs).orderBy("entry_ord").collect():
        found[row.source_sitemap].append(row["loc"])
    assert found == {name: d[3] for name, d in DOCUMENTS.items()}


def test_children_keep_document_positions(captures):
    body = "<sitemapindex><sitemap><loc/></sitemap><sitemap><loc>a</loc></sitemap><sitemap><loc>a</loc></sitemap></sitemapindex>"
    rows = sitemap_children(parse_sitemaps(captures(dict(url="i", body=body)))).collect()
    assert sorted(tuple(r) for r in rows) == [("i", "a", 1), ("i", "a", 2)]


def test_lastmod_is_text(captures):
    body = SET % "<url><loc>a</loc><lastmod>yesterday</lastmod></url><url><loc>b</loc><lastmod/></url>"
    rows = {r["loc"]: r.lastmod for r in sitemap_pages(parse_sitemaps(captures(dict(url="s", body=body)))).collect()}
    assert rows == {"a": "yesterday", "b": None}


def test_error_precedence(captures):
    rows = captures(
        dict(url="net", fetch_error="timeout", status_code=404, status_text="404 Not Found"),
        dict(url="http", status_code=404, status_text="404 Not Found", body="<html>"),
        dict(url="xml", body="<html>"),
        dict(url="root", body="<feed/>"),
    )
    errors = {r.url: r.error for r in parse_sitemaps(rows).collect()}
    assert errors == {
        "net": "timeout",
        "http": "fetch sitemap http: unexpected status 404 Not Found",
        "xml": "malformed XML",
        "root": 'unsupported root element "feed"',
    }


def test_parser_runs_once(captures):
    plan = sitemap_pages(parse_sitemaps(captures(dict(url="s", body="<urlset/>"))))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("from_xml(") == 1


# name: (body, whether it has the plain form)
FORMS = {
    "usual": (HEAD + '\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\r\n  <url>\n<loc>a</loc><lastmod>d</lastmod><changefreq>daily</changefreq><priority>1.0</priority></url>\n</urlset>\n', True),
    "references": (SET % "<url><loc>a?x=1&amp;y=&lt;&gt;&quot;&apos;&amp;lt;</loc></url>", True),
    "last-of-two": (SET % "<url><loc>a</loc><loc>b</loc><lastmod>1</lastmod><lastmod>2</lastmod></url>", True),
    "no-location": (SET % "<url><lastmod>1</lastmod></url><url></url><url>\n</url>", True),
    "blanks": (SET % "<url><loc>\n a\tb </loc></url>", True),
    "images": ('<urlset xmlns:image="i">' + "<url><loc>a</loc><image:image><image:loc>i1</image:loc><image:title>t &amp; u</image:title></image:image></url>" * 2 + "</urlset>", True),
    "alternates": ('<urlset xmlns:xhtml="h"><url><loc>a</loc><xhtml:link rel="alternate" hreflang="de" href="b"/><xhtml:link href=\'c\'></xhtml:link></url></urlset>', True),
    "index": ("<sitemapindex><sitemap><loc>a&amp;b</loc><lastmod>d</lastmod></sitemap></sitemapindex>", True),
    "empty": ("<urlset></urlset>", True),
    "text-after-root": (SET % "<url><loc>a</loc></url>" + "<x", True),
    "prefixed-location": ('<urlset xmlns:v="v"><url><v:loc>b</v:loc></url></urlset>', False),
    "comment": (SET % "<!-- x --><url><loc>a</loc></url>", False),
    "cdata": (SET % "<url><loc><![CDATA[a]]></loc></url>", False),
    "number-reference": (SET % "<url><loc>a&#38;b</loc></url>", False),
    "return-in-text": (SET % "<url><loc>a\r\nb</loc></url>", False),
    "control-character": (SET % "<url><loc>a\x01</loc></url>", False),
    "section-end-in-text": (SET % "<url><loc>a]]>b</loc></url>", False),
    "text-between": (SET % "x<url><loc>a</loc></url>", False),
    "nested": (SET % "<url><loc>a<b>c</b></loc></url>", False),
    "other-element": (SET % "<url><loc>a</loc><news>x</news></url>", False),
    "wrong-end": (SET % "<url><loc>a</lastmod></url>", False),
    "wrong-prefixed-end": ('<urlset xmlns:i="i"><url><loc>a</loc><i:x>1</i:y></url></urlset>', False),
    "cut-off": ("<urlset><url><loc>a</loc></url>", False),
    "index-items-in-set": (SET % "<sitemap><loc>a</loc></sitemap>", False),
}


def outcome(docs):
    return {
        r.url: (r.status, r.type, r.children or [], [tuple(e) for e in r.entries or []]) for r in docs.collect()
    }


def test_plain_form_gives_what_the_parser_gives(captures, monkeypatch):
    rows = captures(*[dict(url=name, body=form[0]) for name, form in {**FORMS, **DOCUMENTS}.items()])
    fast = outcome(parse_sitemaps(rows))
    monkeypatch.setattr(sitemaps, "_is_plain", lambda xml, root: F.lit(False))
    assert fast == outcome(parse_sitemaps(rows))
    assert fast["last-of-two"][3] == [("b", "2")] and fast["images"][3] == [("a", None)] * 2
    assert fast["references"][3] == [("a?x=1&y=<>\"'&lt;", None)]


def test_plain_form_is_recognised(captures):
    rows = captures(*[dict(url=name, body=form[0]) for name, form in FORMS.items()])
    xml = F.col("body").cast("string")
    root = F.regexp_extract(xml, sitemaps._ROOT, 1)
    got = {r.url: r.plain for r in rows.select("url", sitemaps._is_plain(xml, root).alias("plain")).collect()}
    assert got == {name: form[1] for name, form in FORMS.items()}


def test_large_plain_document(captures):
    body = SET % ("<url><loc>https://a/x</loc><i:i><i:l>1</i:l></i:i></url>" * 30_000)
    assert sitemap_pages(parse_sitemaps(captures(dict(url="s", body=body)))).count() == 30_000
