from wareloom.operators.reports import failed_sitemaps, resolve_summary, slowest_sitemaps
from wareloom.operators.resolve import resolve_sitemaps


def index(*locations):
    return "<sitemapindex>%s</sitemapindex>" % "".join(f"<sitemap><loc>{loc}</loc></sitemap>" for loc in locations)


def urlset(*locations):
    return "<urlset>%s</urlset>" % "".join(f"<url><loc>{loc}</loc></url>" for loc in locations)


def resolve(spark, captures, documents, starts):
    rows = [dict(url=url, body=body, duration_ms=len(url)) for url, body in documents.items()]
    return resolve_sitemaps(captures(*rows), spark.createDataFrame(list(zip(starts, range(9))), "url string, ord long"))


def test_closure_with_cycles_and_missing_documents(spark, captures):
    documents = {
        "root": index("b", "root", "c", "lost"),
        "b": index("c", "deep"),
        "c": urlset("p1", "p2", "p1"),
        "deep": index("root", "b", "set2"),
        "set2": urlset("p1"),
        "unreached": urlset("p9"),
    }
    records, pages = resolve(spark, captures, documents, ["root", "root", "c"])
    found = {r["loc"]: (r.discovered_from, r.status, r.type, r.error, r.depth) for r in records.collect()}
    assert found == {
        "root": ("robots.txt", "success", "sitemapindex", None, 0),
        "c": ("robots.txt", "success", "urlset", None, 0),
        "b": ("root", "success", "sitemapindex", None, 1),
        "lost": ("root", "failed", None, "not captured", 1),
        "deep": ("b", "success", "sitemapindex", None, 2),
        "set2": ("deep", "success", "urlset", None, 3),
    }
    in_order = [(r["loc"], r.source_sitemap) for r in pages.orderBy("seq").collect()]
    assert in_order == [("p1", "c"), ("p2", "c"), ("p1", "c"), ("p1", "set2")]
    assert resolve_summary(records, pages).first().asDict() == dict(
        sitemaps_attempted=6, sitemaps_succeeded=5, sitemaps_failed=1, sitemap_indexes=3, url_sets=2, final_urls=4,
        failed_pages=0,
    )
    assert [tuple(r) for r in slowest_sitemaps(records, 3).collect()] == [(4, "deep"), (4, "root"), (4, "set2")]
    assert [tuple(r) for r in failed_sitemaps(records).collect()] == [("lost", "not captured")]


def test_first_parent_owns_a_child(spark, captures):
    documents = {"r": index("a", "b"), "a": index("x", "y"), "b": index("y", "x"), "x": urlset(), "y": urlset()}
    records, _ = resolve(spark, captures, documents, ["r"])
    owners = {r["loc"]: r.discovered_from for r in records.collect()}
    assert owners["x"] == owners["y"] == "a"
    order = [r["loc"] for r in records.orderBy("seq").collect()]
    assert order == ["r", "a", "b", "x", "y"]


def test_blanks_are_part_of_a_location(spark, captures):
    records, _ = resolve(spark, captures, {"r": index(" a", "a"), "a": urlset()}, ["r"])
    assert {r["loc"]: r.status for r in records.collect()} == {"r": "success", " a": "failed", "a": "success"}


def test_nothing_to_start_from(spark, captures):
    records, pages = resolve(spark, captures, {"a": urlset("p")}, [])
    assert records.count() == pages.count() == 0
