"""Product objects in the JSON-LD scripts of captured HTML."""

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from wareloom.fixed_values import JSONLD_TYPE
from wareloom.functions import jsonld
from wareloom.functions.text import body_text

# Workers may not have the package installed, so the helpers travel with the job.
cloudpickle.register_pickle_by_value(jsonld)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A page is read as HTML tokens with one regular expression, so that scripts inside
# comments, raw-text elements and attribute values are not taken for scripts. All
# loops are possessive: matching is iterative and never backtracks over a page.
_BLANK = r"[ \t\n\f\r]"
_NAME_ENDS = r"(?=[ \t\n\f\r/>])"
_ATTRIBUTE = (
    r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+"
    rf"(?:{_BLANK}*+={_BLANK}*+(?:\"[^\"]*+(?:\"|\z)|'[^']*+(?:'|\z)|[^ \t\n\f\r\"'>][^ \t\n\f\r>]*+)?+)?+"
)
_ATTRIBUTES = rf"(?:[ \t\n\f\r/]++|{_ATTRIBUTE})*+"
_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\z))"
_RAW_ELEMENT = (
    rf"<(style|textarea|title|xmp|iframe|noembed|noframes|noscript){_NAME_ENDS}{_ATTRIBUTES}"
    rf"(?:>(?:[^<]++|<(?!/\1{_NAME_ENDS}))*+|\z)"
)
_PLAIN_TEXT = rf"<plaintext{_NAME_ENDS}.*+"
_OTHER_TAG = rf"<(?!script{_NAME_ENDS})/?[a-z][^ \t\n\f\r/>]*+{_ATTRIBUTES}(?:>|\z)"
_BOGUS_COMMENT = r"<(?:[!?]|/[^a-z])[^>]*+(?:>|\z)"
_OTHER_TEXT = rf"[^<]++|<(?!script{_NAME_ENDS})"
_SKIPPED = f"(?:{_COMMENT}|{_RAW_ELEMENT}|{_PLAIN_TEXT}|{_OTHER_TAG}|{_BOGUS_COMMENT}|{_OTHER_TEXT})*+"

# Script text ends at the first end tag, unless a comment inside it has opened
# another script: then that inner end tag does not count.
_INNER_SCRIPT = rf"<script{_NAME_ENDS}(?:(?!</script{_NAME_ENDS}|-->).)*+(?:</script|(?=-->)|\z)"
_SCRIPT_COMMENT = (
    rf"<!--(?!-?>)(?:[^<-]++|-(?!->)|{_INNER_SCRIPT}|<(?!/script{_NAME_ENDS}))*+(?:-->|(?=</script{_NAME_ENDS})|\z)"
)
_SCRIPT_TEXT = rf"(?:[^<]++|{_SCRIPT_COMMENT}|<(?!/script{_NAME_ENDS}))*+"
_SCRIPT_HEAD = rf"<script{_NAME_ENDS}{_ATTRIBUTES}>"

_SCRIPTS = rf"(?si)\G{_SKIPPED}({_SCRIPT_HEAD}{_SCRIPT_TEXT})"
_HEAD = rf"(?si)^({_SCRIPT_HEAD})"
_TYPE_VALUE = (
    rf"(?si)^<script{_NAME_ENDS}(?:[ \t\n\f\r/]++|(?!type[ \t\n\f\r/>=]){_ATTRIBUTE})*+"
    rf"type{_BLANK}*+={_BLANK}*+(\"[^\"]*\"|'[^']*'|[^ \t\n\f\r\"'>][^ \t\n\f\r>]*)"
)
_ENCODED_TYPE = (
    rf"(?si)<script{_NAME_ENDS}(?:[ \t\n\f\r/]++|(?!type[ \t\n\f\r/>=]){_ATTRIBUTE})*+"
    rf"type{_BLANK}*+={_BLANK}*+(?:\"[^\"&]*&|'[^'&]*&|[^ \t\n\f\r\"'>&]*&)"
)


def may_have_jsonld(text):
    """Cheap superset test: a page failing it has no JSON-LD script."""
    return text.contains("ld+json") | text.rlike(_ENCODED_TYPE)


def _script_parts(script):
    head = F.regexp_extract(script, _HEAD, 1)
    value = F.regexp_extract(script, _TYPE_VALUE, 1)
    unquoted = F.when(value.rlike("^[\"']"), F.substring(value, 2, 1 << 30)).otherwise(value)
    return F.struct(
        F.when(value.rlike("^[\"']"), F.regexp_replace(unquoted, "(?s).$", "")).otherwise(value).alias("type"),
        F.substr(script, F.length(head) + 1).alias("text"),
    )


def _with_scripts(captures):
    """Captures with the body replaced by `_scripts`, the page's JSON-LD scripts (type, text)."""
    keep = [name for name in captures.columns if name not in ("body", "products")]
    found = F.transform(F.regexp_extract_all("_text", F.lit(_SCRIPTS), F.lit(2)), _script_parts)
    wanted = F.filter(found, lambda s: (s["type"] == JSONLD_TYPE) | s["type"].contains("&"))
    usable = F.col("fetch_error").isNull() & F.col("status_code").between(200, 299)
    texts = captures.select(*keep, F.when(usable, body_text(F.col("body"))).alias("_text"))
    return texts.select(*keep, F.when(may_have_jsonld(F.col("_text")), wanted).alias("_scripts"))


def jsonld_scripts(captures):
    """JSON-LD script texts of 2xx captures as (url, script_ord, script_type, script, batch_id, seq).

    `script_ord` counts the page's JSON-LD scripts. A type with character references
    is let through for the extraction stage to decide.
    """
    pages = _with_scripts(captures.select("url", "status_code", "fetch_error", "body", "batch_id", "seq"))
    rows = pages.select("url", F.posexplode_outer("_scripts").alias("script_ord", "_script"), "batch_id", "seq")
    return rows.filter(F.col("script_ord").isNotNull()).select(
        "url",
        "script_ord",
        F.col("_script.type").alias("script_type"),
        F.col("_script.text").alias("script"),
        "batch_id",
        "seq",
    )


def _product_lists():
    def run(types: pa.Array, texts: pa.Array) -> pa.Array:
        decoder = jsonld.literal_decoder()
        rows = []
        for page_types, page_texts in zip(types.to_pylist(), texts.to_pylist()):
            scripts = enumerate(zip(page_types or (), page_texts or ()))
            rows.append([
                {"script_ord": script, "product_ord": place, "raw_json": product}
                for script, pair in scripts
                for place, product in enumerate(jsonld.script_products(*pair, decoder))
            ])
        return pa.array(rows, _PRODUCT_LIST)

    # Not deterministic as far as the optimizer knows, or filters on its result would
    # be pushed below and walk every script twice.
    return F.arrow_udf(run, "array<struct<script_ord:int,product_ord:int,raw_json:string>>").asNondeterministic()


_PRODUCT_LIST = pa.list_(
    pa.struct([("script_ord", pa.int32()), ("product_ord", pa.int32()), ("raw_json", pa.string())])
)


def with_products(captures):
    """Captures with `body` replaced by `products`, the page's products in document order.

    Map-only, one pass over the bodies: the prefilter, the HTML tokens and the type
    test run on the JVM, so Python sees nothing but the text of JSON-LD scripts. The
    rows that come out are narrow and serve both outcomes and products.
    """
    pages = _with_scripts(captures)
    keep = [name for name in pages.columns if name != "_scripts"]
    return pages.select(*keep, _product_lists()(F.col("_scripts.type"), F.col("_scripts.text")).alias("products"))


def explode_products(pages):
    """Rows (url, script_ord, product_ord, raw_json, batch_id, seq) from `with_products`."""
    rows = pages.select("url", F.explode_outer("products").alias("product"), "batch_id", "seq")
    return rows.filter(F.col("product").isNotNull()).select("url", "product.*", "batch_id", "seq")


def extract_products(captures):
    """Products as (url, script_ord, product_ord, raw_json, batch_id, seq)."""
    narrow = captures.select("url", "status_code", "fetch_error", "body", "batch_id", "seq")
    return explode_products(with_products(narrow))
