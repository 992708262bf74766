"""Sitemap documents: classification, index links and page entries."""

from pyspark.sql import functions as F

from wareloom.fixed_values import (
    EMPTY_INPUT,
    FAILED,
    FETCH_SITEMAP,
    INDEX_ROOT,
    SET_ROOT,
    SUCCESS,
    UNEXPECTED_STATUS,
    UNSUPPORTED_ROOT,
)
from wareloom.functions.text import empty_to_null

# The corrupt-record field has to come last, otherwise fields are mixed up.
_DOCUMENT = (
    "url array<struct<loc:string,lastmod:string>>, sitemap array<struct<loc:string,lastmod:string>>, _corrupt string"
)
_OPTIONS = {
    "ignoreNamespace": "true",
    "ignoreSurroundingSpaces": "false",
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt",
}

# Possessive quantifiers keep the match iterative on documents with many comments.
_ROOT = (
    r"(?s)^\x{FEFF}?(?:\s++|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^\[>]*+(?:\[.*?\])?\s*+>)*+"
    r"<(?![!?/])(?:[^\s<>/:]++:)?([^\s<>/:]++)"
)
_LEADING_BLANK = r"^[\x{FEFF}\s]+"
_DECLARED_ENCODING = r"(?s)^[\x{FEFF}\s]*<\?xml[^>]*?\sencoding\s*=\s*[\"']([^\"']*)[\"']"
_DECLARED_VERSION = r"(?s)^[\x{FEFF}\s]*<\?xml[^>]*?\sversion\s*=\s*[\"']([^\"']*)[\"']"

# Element names count with their exact case, but field lookup follows the session's
# case setting; tags in another case are given a name nobody looks for.
_OTHER_CASE = (
    r"(</?(?:[^\s<>/:]+:)?)(?!(?:url|sitemap|loc|lastmod)[\s/>])(?=(?i:url|sitemap|loc|lastmod)[\s/>])"
)
# Most sitemaps are plain: nothing but the usual elements, extension elements with a
# prefix, and the five predefined references. One possessive expression tells whether a
# document is of this form, which also proves it well-formed; its entries are then cut
# out as text, several times faster than by the XML parser, which reads all the rest.
_BLANK = r"[ \t\r\n]*+"
_TEXT = r"[^<&\p{Cntrl}]*+(?:(?:[\t\n]|&(?:amp|lt|gt|quot|apos);)[^<&\p{Cntrl}]*+)*+"
_ATTRIBUTES = (
    r"(?:[ \t\r\n]++[A-Za-z_][\w:.-]*+=(?:\"[^\"<&\p{Cntrl}]*+\"|'[^'<&\p{Cntrl}]*+'))*+" + _BLANK
)
_PREFIXED = r"[A-Za-z]++:(?!(?:loc|lastmod|url|sitemap)[ \t\r\n/>])[A-Za-z_]++"
_EXTENSION = (
    rf"<({_PREFIXED}){_ATTRIBUTES}(?:/>|>{_TEXT}(?:<([A-Za-z]++:[A-Za-z_]++)>{_TEXT}</\2>{_BLANK})*+</\1>)"
)


def _plain_form(root, item):
    fields = "|".join(f"<{name}>{_TEXT}</{name}>" for name in ("loc", "lastmod", "changefreq", "priority"))
    return (
        rf"^(?:<\?xml[ \t\r\n][^?>]*+\?>)?+{_BLANK}<{root}{_ATTRIBUTES}>{_BLANK}"
        rf"(?:<{item}>{_BLANK}(?:(?:{fields}|{_EXTENSION}){_BLANK})*+</{item}>{_BLANK})*+</{root}>"
    )


_NOT_PLAIN = ("]]>", chr(0xFFFE), chr(0xFFFF))
_PLAIN_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))

_NESTED_MARKUP = r"(?s)<([^\s<>/]+)(?:\s[^<>]*)?>.*?</\1\s*>|<[^\s<>/]+(?:\s[^<>]*)?/>"


def _own_text(col):
    """Direct text of an element; nested elements and their text are left out."""
    return F.when(col.contains("<"), F.regexp_replace(col, _NESTED_MARKUP, "")).otherwise(col)


def _entry(loc, lastmod):
    return F.struct(loc.alias("loc"), lastmod.alias("lastmod"))


def _is_plain(xml, root):
    form = F.when(root == SET_ROOT, xml.rlike(_plain_form(SET_ROOT, "url"))).when(
        root == INDEX_ROOT, xml.rlike(_plain_form(INDEX_ROOT, "sitemap"))
    )
    for text in _NOT_PLAIN:
        form = form & ~xml.contains(text)
    return F.coalesce(form, F.lit(False))


def _plain_field(block, name):
    """Text of the last `name` element of a plain entry, NULL when it has none."""
    text = F.substring_index(F.substring_index(block, f"<{name}>", -1), f"</{name}>", 1)
    unescaped = text
    for reference, char in _PLAIN_REFERENCES:
        unescaped = F.replace(unescaped, F.lit(reference), F.lit(char))
    return F.when(block.contains(f"<{name}>"), F.when(text.contains("&"), unescaped).otherwise(text))


def _plain_blocks(xml, item):
    parts = F.split(xml, f"<{item}>")
    return F.slice(parts, F.lit(2), F.size(parts))


def parse_sitemaps(captures):
    """One row per captured document with its outcome and its entries.

    `children` holds the entry locations of an index, `entries` those of a URL set;
    both keep empty entries so positions match the document. Failures, in order of
    precedence: fetch error, status outside 2xx, undecodable or malformed XML,
    unknown root element.
    """
    text = F.col("body").cast("string")
    texted = captures.select(
        "url", "status_code", "status_text", "fetch_error", "delay_ms", "duration_ms", "batch_id", "seq",
        F.when(F.col("fetch_error").isNull() & F.col("status_code").between(200, 299), text).alias("_text"),
    )
    encoding = F.regexp_extract("_text", _DECLARED_ENCODING, 1)
    version = F.regexp_extract("_text", _DECLARED_VERSION, 1)
    checked = texted.withColumn(
        "_problem",
        F.when(F.col("fetch_error").isNotNull(), F.col("fetch_error"))
        .when(F.col("status_code").isNull(), F.lit("no status"))
        .when(
            ~F.col("status_code").between(200, 299),
            F.concat(F.lit(FETCH_SITEMAP), F.col("url"), F.lit(f": {UNEXPECTED_STATUS}"), F.col("status_text")),
        )
        .when(F.col("_text").isNull() | (F.col("_text") == ""), F.lit(EMPTY_INPUT))
        .when(~F.is_valid_utf8("_text"), F.lit("malformed XML: invalid UTF-8"))
        .when(
            (encoding != "") & (F.lower(encoding) != "utf-8"),
            F.concat(F.lit("malformed XML: unsupported encoding "), encoding),
        )
        .when(
            (version != "") & (version != "1.0"), F.concat(F.lit("malformed XML: unsupported version "), version)
        ),
    )
    stripped = F.regexp_replace("_text", _LEADING_BLANK, "")
    rooted = checked.withColumn("_xml", F.when(F.col("_problem").isNull(), stripped)).withColumn(
        "_root", F.when(F.col("_problem").isNull(), F.regexp_extract("_xml", _ROOT, 1))
    )
    sorted_out = rooted.withColumn("_plain", _is_plain(F.col("_xml"), F.col("_root")))
    exact = F.when(F.col("_xml").rlike(_OTHER_CASE), F.regexp_replace("_xml", _OTHER_CASE, "$1other-"))
    general = F.when(~F.col("_plain"), F.coalesce(exact, F.col("_xml")))
    parsed = sorted_out.withColumn("_doc", F.from_xml(general, _DOCUMENT, _OPTIONS))
    error = (
        F.when(F.col("_problem").isNotNull(), F.col("_problem"))
        .when(~F.col("_plain") & (F.col("_doc._corrupt").isNotNull() | (F.col("_root") == "")), F.lit("malformed XML"))
        .when(
            ~F.col("_root").isin(INDEX_ROOT, SET_ROOT),
            F.concat(F.lit(UNSUPPORTED_ROOT + '"'), F.col("_root"), F.lit('"')),
        )
    )
    judged = parsed.select(
        "url", "delay_ms", "duration_ms", "batch_id", "seq", "_root", "_plain", "_xml",
        error.alias("error"),
        F.col("_doc.sitemap").alias("_sitemap"),
        F.col("_doc.url").alias("_url"),
    )
    ok = F.col("error").isNull()
    return judged.select(
        "url",
        F.when(ok, F.lit(SUCCESS)).otherwise(F.lit(FAILED)).alias("status"),
        F.when(ok, F.col("_root")).alias("type"),
        "error",
        F.coalesce("delay_ms", F.lit(0)).alias("delay_ms"),
        F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"),
        "batch_id",
        "seq",
        F.when(
            ok & (F.col("_root") == INDEX_ROOT),
            F.when(
                F.col("_plain"),
                F.transform(_plain_blocks(F.col("_xml"), "sitemap"), lambda e: _plain_field(e, "loc")),
            ).otherwise(F.transform("_sitemap", lambda e: _own_text(e["loc"]))),
        ).alias("children"),
        F.when(
            ok & (F.col("_root") == SET_ROOT),
            F.when(
                F.col("_plain"),
                F.transform(
                    _plain_blocks(F.col("_xml"), "url"),
                    lambda e: _entry(_plain_field(e, "loc"), _plain_field(e, "lastmod")),
                ),
            ).otherwise(F.transform("_url", lambda e: _entry(_own_text(e["loc"]), _own_text(e["lastmod"])))),
        ).alias("entries"),
    )


# The outer form of explode is used on purpose: the plain one makes the optimizer add
# a size test on its input, which is pushed below the parser and parses every document
# twice. Rows without entries fall to the test for an empty location.


def sitemap_children(docs):
    """Index entries as edges (parent, child, entry_ord)."""
    edges = docs.select(F.col("url").alias("parent"), F.posexplode_outer("children").alias("entry_ord", "child"))
    return edges.filter(F.col("child") != "").select("parent", "child", F.col("entry_ord").cast("bigint"))


def sitemap_pages(docs):
    """URL-set entries as (loc, lastmod, source_sitemap, entry_ord); repeats are kept."""
    entries = docs.select(F.col("url").alias("source_sitemap"), F.posexplode_outer("entries").alias("entry_ord", "entry"))
    return entries.filter(F.col("entry.loc") != "").select(
        "entry.loc",
        empty_to_null(F.col("entry.lastmod")).alias("lastmod"),
        "source_sitemap",
        F.col("entry_ord").cast("bigint"),
    )
