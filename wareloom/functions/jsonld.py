"""Product objects inside one JSON-LD script; runs inside Arrow batches.

Spark's own JSON functions rewrite number literals (1.10 becomes 1.1) and would
follow JSON text held in strings, so the walk is done on the parsed value.
"""

import html
import json
import re
from json.encoder import encode_basestring

from wareloom.fixed_values import JSONLD_TYPE, PRODUCT_TYPES

_LONE_SURROGATE = re.compile("[\ud800-\udfff]")
_REPLACEMENT = chr(0xFFFD)
_ESCAPED_IN_OUTPUT = re.compile(f"[<>&{chr(0x2028)}{chr(0x2029)}]")


class Literal(str):
    """A number kept as the text it was written as."""


def _reject(name):
    raise ValueError(name)


def literal_decoder():
    """JSON decoder that keeps numbers as text and takes no NaN or Infinity."""
    return json.JSONDecoder(parse_float=Literal, parse_int=Literal, parse_constant=_reject)


def first_value(text, decoder):
    """First JSON value of the text; what follows it is not looked at."""
    return decoder.raw_decode(text.lstrip(" \t\r\n"))[0]


def is_product_type(value):
    """A product type name in any case, alone or anywhere in nested lists."""
    waiting = [value]
    while waiting:
        item = waiting.pop()
        if isinstance(item, list):
            waiting.extend(item)
        elif isinstance(item, str) and not isinstance(item, Literal) and item.casefold() in PRODUCT_TYPES:
            return True
    return False


def product_objects(value):
    """Objects typed as products, reached through lists and @graph only.

    An object's @graph members come before the object itself.
    """
    waiting = [(value, False)]
    while waiting:
        node, graph_done = waiting.pop()
        if isinstance(node, list):
            waiting.extend((item, False) for item in reversed(node))
        elif isinstance(node, dict):
            if "@graph" in node and not graph_done:
                waiting.append((node, True))
                waiting.append((node["@graph"], False))
            elif is_product_type(node.get("@type")):
                yield node


def _quote(text):
    text = encode_basestring(_LONE_SURROGATE.sub(_REPLACEMENT, text))
    return _ESCAPED_IN_OUTPUT.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def canonical_json(value):
    """Compact JSON with sorted keys, number literals kept and mark-up characters escaped.

    Works off a stack of values and finished pieces, so deep nesting is no problem.
    """
    out, waiting = [], [value]
    while waiting:
        item = waiting.pop()
        if isinstance(item, Literal):
            out.append(item)
        elif isinstance(item, str):
            out.append(_quote(item))
        elif isinstance(item, dict):
            clean = {_LONE_SURROGATE.sub(_REPLACEMENT, key): member for key, member in item.items()}
            waiting.append(Literal("}"))
            for place, key in reversed(list(enumerate(sorted(clean)))):
                waiting.append(clean[key])
                waiting.append(Literal(f"{',' if place else '{'}{_quote(key)}:"))
            if not clean:
                waiting.append(Literal("{"))
        elif isinstance(item, list):
            waiting.append(Literal("]"))
            for place, member in reversed(list(enumerate(item))):
                waiting.append(member)
                waiting.append(Literal("," if place else "["))
            if not item:
                waiting.append(Literal("["))
        else:
            out.append({None: "null", True: "true", False: "false"}[item])
    return "".join(out)


def script_products(script_type, text, decoder):
    """Canonical JSON of every product in a script, in document order."""
    if html.unescape(script_type) != JSONLD_TYPE:
        return []
    try:
        return [canonical_json(node) for node in product_objects(first_value(text, decoder))]
    except (ValueError, RecursionError):
        return []
