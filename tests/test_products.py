import json

import pytest

from wareloom.functions.jsonld import canonical_json, first_value, literal_decoder, script_products
from wareloom.operators.decode import decode_captures
from wareloom.operators.products import extract_products, jsonld_scripts, with_products

OPEN, CLOSE = '<script type="application/ld+json">', "</script>"
P = '{"@type":"Product"}'
LD = OPEN + P + CLOSE

# name: (html, number of products)
PAGES = {
    "plain": (f"<html><head>{LD}</head></html>", 1),
    "upper-case-tags": ('<SCRIPT TYPE="application/ld+json">' + P + "</SCRIPT >", 1),
    "single-quotes": ("<script type='application/ld+json'>" + P + CLOSE, 1),
    "no-quotes": ("<script type=application/ld+json>" + P + CLOSE, 1),
    "blanks-around-equals": ('<script type = "application/ld+json" >' + P + CLOSE, 1),
    "more-attributes": (f'<script data-x="a>b" async id=1 type="application/ld+json" nonce>{P}{CLOSE}', 1),
    "first-type-wins": (f'<script type="text/plain" type="application/ld+json">{P}{CLOSE}', 0),
    "other-attribute": (f'<script data-type="application/ld+json">{P}{CLOSE}', 0),
    "type-in-value": (f"""<script data-x='type="application/ld+json"'>{P}{CLOSE}""", 0),
    "charset": (f'<script type="application/ld+json; charset=utf-8">{P}{CLOSE}', 0),
    "type-case": (f'<script type="Application/LD+JSON">{P}{CLOSE}', 0),
    "type-blank": (f'<script type=" application/ld+json">{P}{CLOSE}', 0),
    "encoded-type": (f'<script type="application/ld&#43;json">{P}{CLOSE}', 1),
    "encoded-type-named": (f'<script type="application&sol;ld&plus;json">{P}{CLOSE}', 1),
    "encoded-other": (f'<script type="a&amp;b">{P}{CLOSE} ld+json', 0),
    "in-comment": (f"<!-- {LD} -->", 0),
    "after-comment": (f"<!--> {LD} -->", 1),
    "after-bang-comment": (f"<!-- x --!> {LD}", 1),
    "open-comment": (f"<!-- {LD}", 0),
    "in-textarea": (f"<textarea>{LD}</textarea>", 0),
    "in-title": (f"<title>{LD}</title>", 0),
    "in-style": (f"<style>{LD}</style>", 0),
    "in-noscript": (f"<noscript>{LD}</noscript>", 0),
    "after-style": (f"<style>p > a {{}} </styles> </style>{LD}", 1),
    "in-attribute": (f"<div data-html='{LD}'></div>", 0),
    "in-other-script": (f'<script>var s = \'{OPEN}{P}<\\/script>\';</script>', 0),
    "after-other-script": (f'<script>if (a < b && c) {{ s = "</p>"; }}</script>{LD}', 1),
    "script-in-script-comment": (f"<script><!-- <script> </script> {OPEN} --></script>{LD}", 1),
    "script-comment": (f"<script><!-- x //--></script>{LD}", 1),
    "bogus-comment": (f'<?php echo "x" ?><!DOCTYPE html></ x>{LD}', 1),
    "less-than-in-text": (f"1 < 2 <3 << {LD}", 1),
    "not-script": (f"<scripts type='application/ld+json'>{P}</scripts>", 0),
    "unclosed": (OPEN + P, 1),
    "unfinished-tag": ('<script type="application/ld+json"', 0),
    "plaintext": (f"<plaintext>{LD}", 0),
    "two": (LD + "<p>x</p>" + LD, 2),
    "malformed-first": (OPEN + '{"@type":' + CLOSE + LD, 1),
    "none": ("<html><script>1</script></html>", 0),
    "empty": ("", 0),
    "not-utf8": (b"<p>\xff</p>" + LD.encode(), 1),
}

# name: (script, expected canonical products)
SCRIPTS = {
    "one-node": ('{"sku": "lamp-7", "@type": "Product"}', ['{"@type":"Product","sku":"lamp-7"}']),
    "graph-of-nodes": (
        '{"@graph": [{"@type": ["Vehicle", "Product"], "sku": "bike-2"}, {"@type": "WebSite"}, {"@type": "Product", "sku": "bell-1"}]}',
        ['{"@type":["Vehicle","Product"],"sku":"bike-2"}', '{"@type":"Product","sku":"bell-1"}'],
    ),
    "numbers": ('{"@type":"Product","a":1.10,"b":1E5,"c":-0,"d":12345678901234567890123456789012345678901234567890}', ['{"@type":"Product","a":1.10,"b":1E5,"c":-0,"d":12345678901234567890123456789012345678901234567890}']),
    "keys-sorted": ('{"b":1,"@type":"Product","a":{"z":null,"y":[true,false]},"é":2,"Z":3}', ['{"@type":"Product","Z":3,"a":{"y":[true,false],"z":null},"b":1,"é":2}']),
    "last-key-wins": ('{"@type":"Thing","@type":"Product","a":1,"a":2}', ['{"@type":"Product","a":2}']),
    "trailing-text": ('{"@type":"Product"};garbage', ['{"@type":"Product"}']),
    "second-value": ('{"@type":"Thing"}{"@type":"Product"}', []),
    "leading-blank": ('\n\t {"@type":"Product"}', ['{"@type":"Product"}']),
    "other-leading-blank": (' {"@type":"Product"}', []),
    "invalid": ('{"@type":"Product",}', []),
    "not-a-number": ('{"@type":"Product","a":NaN}', []),
    "control-character": ('{"@type":"Product","a":"x\ny"}', []),
    "comment": ('<!-- {"@type":"Product"} -->', []),
    "list": ('[{"@type":"Product","n":1},[{"@type":"product","n":2}],"x",3]', ['{"@type":"Product","n":1}', '{"@type":"product","n":2}']),
    "other-keys": ('{"@type":"WebPage","mainEntity":{"@type":"Product"}}', []),
    "inside-product": ('{"@type":"Product","isRelatedTo":{"@type":"Product"}}', ['{"@type":"Product","isRelatedTo":{"@type":"Product"}}']),
    "graph-before-node": ('{"@type":"Product","@graph":{"@type":"Product","n":1}}', ['{"@type":"Product","n":1}', '{"@graph":{"@type":"Product","n":1},"@type":"Product"}']),
    "json-in-string": ('["{\\"@type\\":\\"Product\\"}"]', []),
    "types": ('[{"@type":"https://schema.org/PRODUCT"},{"@type":"http://schema.org/Product"},{"@type":"schema:Product"},{"@type":[["x",["PRODUCT"]]]},{"@type":{"a":"Product"}},{"@type":null},{"type":"Product"}]', ['{"@type":"https://schema.org/PRODUCT"}', '{"@type":[["x",["PRODUCT"]]]}']),
    "lone-surrogate": ('{"@type":"Product","a":"\\ud800x"}', ['{"@type":"Product","a":"' + chr(0xFFFD) + 'x"}']),
    "pair": ('{"@type":"Product","a":"\\ud83d\\ude00"}', ['{"@type":"Product","a":"😀"}']),
    "empties": ('{"@type":"Product","a":{},"b":[],"c":[[],{}],"d":""}', ['{"@type":"Product","a":{},"b":[],"c":[[],{}],"d":""}']),
    "deep-inside": ('{"@type":"Product","a":' + "[" * 1500 + "1.0" + "]" * 1500 + "}", ['{"@type":"Product","a":' + "[" * 1500 + "1.0" + "]" * 1500 + "}"]),
    "deep": ("[" * 400 + '{"@type":"Product"}' + "]" * 400, ['{"@type":"Product"}']),
}


def test_pages(captures):
    rows = captures(*[dict(url=name, body=page[0]) for name, page in PAGES.items()])
    counted = {name: 0 for name in PAGES}
    for row in extract_products(rows).collect():
        counted[row.url] += 1
    assert counted == {name: page[1] for name, page in PAGES.items()}


def test_scripts(captures):
    rows = captures(*[dict(url=name, body=f"<p>{OPEN}{s[0]}{CLOSE}") for name, s in SCRIPTS.items()])
    found = {name: [] for name in SCRIPTS}
    for row in extract_products(rows).orderBy("url", "script_ord", "product_ord").collect():
        found[row.url].append(row.raw_json)
    assert found == {name: s[1] for name, s in SCRIPTS.items()}


def test_escaping():
    escaped = canonical_json(first_value(r'{"a":"<b> &    \" \\ \/ \b\f\n\r\t\u0001\u007f"}', literal_decoder()))
    back = chr(92)
    assert escaped == (
        f'{{"a":"{back}u003cb{back}u003e {back}u0026 {back}u2028{back}u2029 {back}" {back}{back} / '
        f'{back}b{back}f{back}n{back}r{back}t{back}u0001{chr(127)}"}}'
    )
    assert json.loads(escaped)["a"].startswith("<b> & ")


def test_order_of_scripts_and_products(captures):
    html = f"{OPEN}[{P},{P}]{CLOSE}<script>x</script>{OPEN}[]{CLOSE}{OPEN}{P}{CLOSE}"
    rows = extract_products(captures(dict(url="u", body=html))).collect()
    assert sorted((r.script_ord, r.product_ord) for r in rows) == [(0, 0), (0, 1), (2, 0)]
    assert jsonld_scripts(captures(dict(url="u", body=html))).count() == 3


def test_only_successful_captures(captures):
    rows = captures(
        dict(url="a", body=LD, status_code=500), dict(url="b", body=LD, fetch_error="x"), dict(url="c", body=LD)
    )
    assert [r.url for r in extract_products(rows).collect()] == ["c"]
    kept = {r.url: len(r.products) for r in with_products(rows).collect()}
    assert kept == {"a": 0, "b": 0, "c": 1}


def test_large_page_with_many_tokens(captures):
    html = "<p class='x'>a < b</p><!-- c -->" * 40_000 + LD
    assert extract_products(captures(dict(url="u", body=html))).count() == 1


def test_bodies_are_decoded_and_walked_once(captures):
    plan = extract_products(decode_captures(captures(dict(url="u", body=LD))))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 2


@pytest.mark.parametrize("script_type", ["application/ld+json", "application/ld&#x2b;json"])
def test_type_references(script_type):
    assert script_products(script_type, P, literal_decoder()) == [P]


def test_long_constructs_do_not_exhaust_the_stack(captures):
    """Every loop of the token expression, with a few hundred thousand turns."""
    many = 300_000
    pages = {
        "comment": "<!--" + "-<x" * many + "-->",
        "script": "<script>" + "a<b " * many + "</script>",
        "script-comment": "<script><!--" + "-<x " * many + "--></script>",
        "inner-script": "<script><!-- <script>" + "<y " * many + "</script> --></script>",
        "raw-element": "<style>" + "a<b " * many + "</style>",
        "attributes": "<p " + 'a="1" b ' * many + ">",
        "attribute": '<p a="' + "x<" * many + '">',
        "tags": "<p><br/>" * many,
        "text": "< 1 <" * many,
        "bogus": "<!x><?y>" * many,
    }
    rows = captures(*[dict(url=name, body=page + LD) for name, page in pages.items()])
    assert {r.url for r in extract_products(rows).collect()} == set(pages)
