import re
import time

import pytest

import corpus_reference as plain
from compare import assert_same
from conftest import SF
from corpus_fixtures import no_docs, odd_docs  # noqa: F401
from wareloom.llm import decontamination, extraction, license_scan, queries, toxicity, url_rules

PAGES = "page_id bigint, url string, html string"


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_matches_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), SF, queries.CHECKS[name])


def test_native_queries_run_no_python(spark):
    for name in ("op3_url_filters", "op9_license_scan"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


# --- URL rules -----------------------------------------------------------------------


def verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = plain.lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h), len(p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "http://com/", "https://EXAMPLE.com/en/1?x#y", "http://www.example.com/en/",
        "http://a.b.www.example.com/en/x", "http://notexample.com/en/", "http://example.com", "http://x.net/es/1#a",
        "http://net/fr/", "http://x.net/de/", "http://example.com.net/en/", "://a..com/", "http://-x.example.com/en/?q",
        "http://www.example.comx/en/", "http://example.com/EN/", "http://example.com/en/", "http://example.com/en/",
    ]
    more = url_rules.RULES + (("a.b.www.example.com", "/en/x", "block"), ("example-x.com", "/", "block"), ("", "/", "block"), ("b.c", "", "block"))
    rows = [(i, url, None) for i, url in enumerate(urls)] + [(None, "http://com/x", None)]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS host", "'y' AS rule", "1 AS key", "2 AS stack")
    for rules in (url_rules.RULES, more):
        got = url_rules.filter_urls(pages, url_rules.rules_table(spark, rules)).collect()
        want = sorted((str(i), *map(str, verdict(url, [r for r in rules if r[0]]))) for i, url, _ in rows)
        assert sorted(tuple(map(str, row)) for row in got) == want
    none = url_rules.filter_urls(pages, url_rules.rules_table(spark).limit(0)).collect()
    assert {row.verdict for row in none} == {"allow"}
    assert url_rules.filter_urls(pages.limit(0), url_rules.rules_table(spark)).count() == 0


# --- extraction ----------------------------------------------------------------------


def article(html):
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    import html as entities

    parts = re.split(r"<(?:/?p|/?h1)>", inner)
    lines = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", " ", part))).strip() for part in parts]
    return "\n".join(line for line in lines if line)


def test_extraction_query(spark):
    html = {row.page_id: row.html for row in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op4_html_extraction(spark, SF).collect()
    assert len(rows) == len(html)
    for row in rows:
        assert row.text == article(html[row.page_id])
        assert row.n_chars == len(row.text)


def test_furniture_is_left_out():
    html = """<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><li>Menu</nav>
    <main><h1>A &amp; B</h1><script>var x = "<p>no</p>";</script><p>One
      <b>bold</b>ed<p>Two<br>lines<div class="ad-box">Buy</div><aside>Side</aside><form>Name <input></form>
      <ul><li>x<li>y</ul><table><tr><td>c1<td>c2</table><section id="comments"><p>First!</p></section>
    </main><div class="cookie-notice">Cookies</div><footer>&copy;</footer>"""
    assert extraction.main_text(html) == "A & B\nOne bolded\nTwo lines\nx\ny\nc1\nc2"
    for odd in ("", "<", "plain", "<p", "<!-- open", "<script>x", "</p></p>", "<p>a<p>b", "a < b & c"):
        extraction.main_text(odd)
    assert extraction.main_text("<p>a<p>b") == "a\nb"


def test_template_text_of_a_host_is_left_out(spark, no_docs):
    def page(i):
        return f"<html><body><div><b>Shop of things</b></div><div><p>Own text {i}</p><p>More {i * 7}</p></div><div><i>All rights</i></div></body></html>"

    rows = [(i, f"http://shop.example.com/{i}", page(i)) for i in range(12)]
    rows += [(50, "http://few.example.com/", page(50)), (51, None, None), (None, "x", ""), (52, "http://few.example.com/", page(50))]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS host", "2 AS text", "3 AS furniture")
    got = {row.page_id: row.text for row in extraction.extract_pages(pages).collect()}
    assert all(got[i] == f"Own text {i}\nMore {i * 7}" for i in range(12))
    assert got[50] == got[52] == "Shop of things\nOwn text 50\nMore 350\nAll rights"
    assert got[51] == got[None] == ""
    assert extraction.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("around", ["layout no-sidebar", "site has-sidebar", "sidebar", "page-header"])
def test_class_of_an_ancestor_does_not_remove_the_article(around):
    html = f"""<body><div class='{around}'><div class="menu">Menu</div><article><h1 class="article-header">Title</h1>
    <p class="social-policy">One <a href='/hidden-valley' title='Hidden gems' data-hidden='false'>two</a> <a href='/p?id=menu' data-role='header'>three</a></p>
    <p data-id='notice-3' class="search-result">Four<span hidden>no</span><b aria-hidden=true>no</b></p><div class="share-box">Share</div></article>
    <div id="comments"><article class="comment">First!</article></div></div></body>"""
    assert extraction.main_text(html) == "Title\nOne two three\nFour"


@pytest.mark.parametrize("name", ["post-comments", "comments", "commentList", "related-posts", "recommended_articles", "disqus_thread"])
def test_comments_and_other_pages_are_left_out(name):
    html = f"<article><p>Real</p><p class='no-comments with-related'>More</p><div class='{name}'><p>Not it</p><article>Nor it</article></div></article>"
    assert extraction.main_text(html) == "Real\nMore"
    assert extraction.main_text(f"<div><p>Real</p><article class='{name}'>Not it</article><section id={name}><p>x</section></div>") == "Real"


def test_a_page_of_nothing_but_furniture_is_empty():
    html = "<body><div class='cookie-notice'><p>Cookies</p></div><div class=ad>Buy</div><nav>Menu</nav><aside>Side</aside></body>"
    assert extraction.main_text(html) == ""
    assert extraction.main_text("<body><div class='sidebar'><p>All there is</p></div></body>") == ""


def test_references_are_decoded_node_by_node():
    assert extraction.main_text("<p>A &<b>lt;</b> B &lt;i&gt; &amp;lt; C&nbsp;D</p>") == "A &lt; B <i> &lt; C D"


def test_quotes_that_never_close():
    assert extraction.main_text("<p title='a>b'>One</p><p title=\"x>Two</p><p>Three</p>") == "One\nTwo\nThree"
    assert extraction.main_text("<p>1 < 2 <3 <a href='x>'>four</a> <b") == "1 < 2 <3 four <b"


@pytest.mark.parametrize(
    "html",
    ["<a " * 300_000, "<a title=\"x>" * 100_000, "<!" * 300_000, "<" * 500_000, "<div>" * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<p>x" * 100_000, "<li>" * 100_000],
    ids=["open", "quotes", "asides", "signs", "nested", "unmatched", "paragraphs", "items"],
)
def test_long_malformed_pages_take_time_in_proportion(html):
    began = time.process_time()
    extraction.main_text(html)
    assert time.process_time() - began < 10


def test_text_that_every_article_has_stays(spark):
    html = "<html><body><div>Shop of things</div><article><p>Own text {0}</p><p>Shared by all articles</p></article></body></html>"
    pages = spark.createDataFrame([(i, f"http://shop.example.com/{i}", html.format(i)) for i in range(12)], PAGES)
    got = {row.page_id: row.text for row in extraction.extract_pages(pages).collect()}
    assert got == {i: f"Own text {i}\nShared by all articles" for i in range(12)}


# --- toxicity ------------------------------------------------------------------------


def test_toxicity_query(spark):
    sf = SF.replace("0.001", "0.01")
    labels = {row.doc_id: row.toxic for row in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op8_toxicity(spark, sf).collect()
    assert all(row.held_out == (plain.doc_crc(row.doc_id) % 3 == 1) for row in rows)
    assert all(0 <= row.score <= 1 and row.predicted == (row.score >= 0.7) for row in rows)
    unseen = [row for row in rows if row.held_out and row.doc_id in labels]
    right = sum(row.predicted == labels[row.doc_id] for row in unseen)
    assert right / len(unseen) >= 0.93


def test_folding_and_exceptions():
    assert toxicity.fold("Y0U 1D10T! clоwn, 2024 $cum")[0] == " you idiot clown 2024 scum "
    built = toxicity.automaton({" clown ": 2.0, " scu": 1.0}, ("clown fish",))
    assert toxicity.matched(" a clown fish and scum clown ", built) == (2, 3.0)
    assert toxicity.matched(" clowns obscure ", built) == (0, 0.0)
    assert toxicity.matched(" x ", toxicity.automaton({}, ())) == (0, 0.0)


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (4, 0, 1), (4, 0, 0)], "doc_id bigint, quality int, toxic int")
    rows = toxicity.score_toxicity(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= row.score <= 1 for row in rows)
    assert toxicity.score_toxicity(odd_docs, labels.limit(0)).count() == len(rows)
    assert toxicity.score_toxicity(no_docs, labels).count() == 0
    assert set(toxicity.drop_toxic(odd_docs, labels.limit(0)).columns) == set(odd_docs.columns)


# --- licences ------------------------------------------------------------------------


def test_licences(spark, odd_docs, no_docs):
    notice = dict(license_scan.TEMPLATES)["MIT-grant"]
    edited = notice.replace("free of charge", "without charge").upper()
    rows = [(1, f"{'word ' * 300}{notice}"), (2, edited), (3, notice[:150]), (4, "x. Released under the\nMIT  license!"), (None, notice), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS license", "2 AS words", "3 AS _s")
    got = sorted((str(row.doc_id), row.license) for row in license_scan.scan_licenses(docs).collect())
    assert got == [("1", "MIT-grant"), ("2", "MIT-grant"), ("4", "MIT"), ("None", "MIT-grant")]
    assert license_scan.scan_licenses(odd_docs).count() == 0
    assert license_scan.scan_licenses(no_docs).count() == 0
    assert license_scan.scan_licenses(docs, [(None, "x"), ("short", "two words")]).count() == 0


@pytest.mark.parametrize("limit", [0, 8, 30, 60])
def test_licences_beyond_the_literals(spark, monkeypatch, limit):
    """However many bands there are for long and short templates, the same licences are found."""
    texts = [text for _, text in license_scan.TEMPLATES]
    docs = spark.createDataFrame([(i, f"some words before {text} and after") for i, text in enumerate(texts)], "doc_id bigint, text string")
    want = sorted((row.doc_id, row.license, row.n_found) for row in license_scan.scan_licenses(docs).collect())
    monkeypatch.setattr(license_scan, "LITERAL_BANDS", limit)
    got = sorted((row.doc_id, row.license, row.n_found) for row in license_scan.scan_licenses(docs).collect())
    assert got == want and {doc_id for doc_id, _, _ in got} == set(range(len(texts)))


# --- decontamination -----------------------------------------------------------------


def test_decontamination_query(spark):
    docs = {row.doc_id: row.text for row in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [row.text for row in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    flat = lambda text: " " + " ".join(re.findall(r"[^\W_]+", text.lower())) + " "
    want = {i for i, text in docs.items() if any(flat(item) in flat(text) for item in items)}
    rows = queries.op10_decontamination(spark, SF).collect()
    assert len(rows) == len(docs) and want
    assert {row.doc_id for row in rows if row.contaminated} == want


def test_questions_with_other_values(spark, odd_docs, no_docs):
    question = "If Anna buys 12 apples and gives 5 apples to Boris, then how many of the 12 apples does the happy Anna keep?"
    other = question.replace("12", "840").replace("5", "17").replace("Anna", "Carla").replace("Boris", "Dieter")
    muddled = other.replace("the 840", "the 99")
    bench = spark.createDataFrame([(7, question), (8, "too short"), (9, None), (None, question), (10, other)], "item_id bigint, text string")
    rows = [(1, f"Some text. {question} More."), (2, f"Intro here: {other}"), (3, muddled), (4, question[:50]), (5, None), (None, other), (2, f"Intro here: {other}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "2 AS window", "3 AS text_key")
    found = decontamination.find_contaminated(docs, bench).collect()
    assert len(found) == len(rows)
    assert {(row.doc_id, row.contaminated, row.item_id) for row in found} == {
        (1, True, 7), (2, True, 7), (3, False, None), (4, False, None), (5, False, None), (None, True, 7)
    }
    left = decontamination.drop_contaminated(docs, bench)
    assert sorted(row.doc_id for row in left.collect()) == [3, 4, 5] and set(left.columns) == set(docs.columns)
    assert decontamination.find_contaminated(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.find_contaminated(odd_docs, bench).filter("contaminated").count() == 0
    assert decontamination.find_contaminated(no_docs, bench).count() == 0


def test_items_without_template_windows_are_found_as_they_are(spark):
    items = [
        "What is 12 + 35 * 4 - 17 / 3?", "Compute 48 * 17 + 9 and 12 * 5.", "Paris, Rome, Oslo, Bern, Wien, Kyiv, Riga", "capital of Peru",
        "水在标准大气压下的沸点是多少度", "SAY who painted the ceiling", "7 7 7 7 7 7 7 7",
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = [(i, f"Before it came this 他问，{item}。他说 and so on") for i, item in enumerate(items)]
    rows += [(20, "What is 12 + 36 * 4 - 17 / 3?"), (21, "the capital of a Peru"), (22, "水在标准大气压下的熔点是多少度"), (23, "7 7 7 7"), (24, "say WHO Painted the ceiling")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {row.doc_id: row.item_id for row in decontamination.find_contaminated(docs, bench).collect() if row.contaminated}
    assert found == {**{i: i for i in range(len(items))}, 24: 5}


def test_slots_at_starts_of_sentences_and_of_money(spark):
    question = (
        "Natalia sold 48 clips to her friends in April for $5 each. Natalia kept the other clips for the rest of the year. "
        "How much money did Natalia make in total?"
    )
    decimals = "The shop sells bags of flour of 2.5 kg at €1,250 a ton, and 12% of them are lost on the way to the town."
    bench = spark.createDataFrame([(1, question), (2, decimals)], "item_id bigint, text string")
    rows = [
        (1, question.replace("Natalia", "Marion")),
        (2, "Question 3\n" + question.replace("Natalia", "Marion").replace("$5", "$7").replace("48", "31").replace(" her", "\nher").replace("in April", "\nin April")),
        (3, "Marion sold 31 clips to her friends, and how much money that was in total is not known."),
        (4, decimals.replace("2.5", "13").replace("€1,250", "€3").replace("12%", "7.5%")),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {row.doc_id: row.item_id for row in decontamination.find_contaminated(docs, bench).collect() if row.contaminated}
    assert found == {1: 1, 2: 1, 4: 2}


def shops(spark, bodies):
    """Main texts of pages of one host."""
    pages = spark.createDataFrame(
        [(i, f"http://shop.example.com/{i}", f"<html><body>{body}</body></html>") for i, body in enumerate(bodies)], PAGES
    )
    return [row.text for row in extraction.extract_pages(pages).orderBy("page_id").collect()]


def test_texts_in_no_fixed_order_are_not_of_the_template(spark):
    """On every page once like the page itself, but two of them change places and one goes anywhere."""
    bodies, wanted = [], []
    for i in range(12):
        lines = ["Nice", f"Own text {i}", "Cheap"][:: 1 - 2 * (i % 2)]
        roaming = "<p>Anywhere</p>"
        parts = ["<div><b>Shop of things</b></div>", "<div><u>Since 1900</u></div>", "".join(f"<p>{line}</p>" for line in lines), "<div><i>All rights</i></div>"]
        parts.insert(i % 5, roaming)
        bodies.append("".join(parts))
        lines.insert(3 if i % 5 > 2 else 0, "Anywhere")
        wanted.append("\n".join(lines))
    assert shops(spark, bodies) == wanted


def test_classes_that_are_not_nested_are_not_of_the_template(spark):
    """Boxes (<table>, with a text of their own) that stand in one gap of the page's class on some pages, in another on others."""
    box = "<table><tr><td>Box text</table>"
    fixed = [f"<div><b>Shop of things</b></div>{box * (1 + i % 2)}<div><i>All rights</i></div><p>Own text {i}</p>" for i in range(12)]
    assert shops(spark, fixed) == [f"Own text {i}" for i in range(12)]
    moving = [
        f"{box * (i % 3 == 0)}<div><b>Shop of things</b></div>{box * (1 + i % 2)}<div><i>All rights</i></div><p>Own text {i}</p>" for i in range(12)
    ]
    assert shops(spark, moving) == ["\n".join(["Box text"] * ((i % 3 == 0) + 1 + i % 2) + [f"Own text {i}"]) for i in range(12)]


def test_order_of_a_class():
    place = {token: at for at, token in enumerate("abcdef")}
    for found, moved in (("abcdef", ""), ("abcdef" * 3, ""), ("bacdef", "ab"), ("bcdeaf", "a"), ("abcdefbcdefa", "a"), ("fabcde", "f")):
        assert extraction.out_of_order(list(found), place) == set(moved)
    # What is left of an occurrence is in each of them, in one order.
    assert extraction.out_of_order(list("abcdfeabecdf"), place) >= set("e")


def test_places_of_classes():
    class_of = dict(A=0, B=0, C=0, d=1, e=1, f=2, g=2)
    sizes = {0: 3, 1: 2, 2: 2}
    places = extraction.page_places("AdedeBfgC", class_of, sizes)
    assert places == ({(0, -1, 0), (1, 0, 1), (2, 0, 2)}, set())
    assert extraction.page_places("AdBeCfg", class_of, sizes) == ({(0, -1, 0), (1, 0, 1), (2, -1, 0)}, {1})
    assert extraction.page_places("ABCdfeg", class_of, sizes)[1] == {2}
    rows = [(0, -1, 0, 0), (1, 0, 1, 0), (2, 1, 1, 0), (3, 2, 1, 0), (3, 1, 1, 0)]
    # 3 lies in 2 on some pages only, so one of them goes; without it, all have one place.
    assert extraction.nested_classes(rows) == {0, 1, 2}
    assert extraction.nested_classes([*rows[:2], (3, 1, 1, 0), (4, -1, 0, 0), (3, 4, 1, 0), (4, 1, 1, 0)]) == {0, 1}
    assert extraction.nested_classes([(0, -1, 0, 0), (0, 1, 1, 0), (1, -1, 0, 0)]) == {0}
    assert extraction.nested_classes([(0, -1, 0, 0), (1, 0, 1, 1)]) == {0}
