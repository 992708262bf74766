"""URL expressions that stay on the JVM.

`parse_url` is not used: it gives NULL for hosts with an underscore and for paths
with a blank, and keeps the brackets of IPv6 literals.
"""

import re

from pyspark.sql import functions as F

_AUTHORITY = (
    r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?"
    r"(?:\[([^\]]*)\]|([^/?#:@]*))(?::\d*)?(?:[/?#]|$)"
)

_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"

# What makes a URL unparsable: control characters, a broken percent escape outside
# the query, a port that is not a number, a host with forbidden characters, or a
# leading colon.
_CONTROL = r"[\x00-\x1F\x7F]"
_BROKEN_ESCAPE = r"^[^?#]*%(?![0-9A-Fa-f]{2})|#.*%(?![0-9A-Fa-f]{2})"
_BAD_PORT = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?+(?:\[[^\]/?#]*\]|[^/?#:@\[]*):[^/?#]*[^0-9/?#]"
_BAD_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?+[^/?#]*[ \\^`{|}]"
_NO_SCHEME = r"^:"


def url_host(col):
    """Host name without port and brackets, case kept; empty when there is none."""
    return F.concat(F.regexp_extract(col, _AUTHORITY, 1), F.regexp_extract(col, _AUTHORITY, 2))


# Stored rows whose URL names no host are kept together under this name.
NO_HOST = "_"


def state_host(col):
    """Host under which a URL's row is stored."""
    return F.coalesce(F.nullif(url_host(col), F.lit("")), F.lit(NO_HOST))


def host_of(url):
    """`url_host` of one URL outside of a DataFrame."""
    match = re.match(_AUTHORITY, url)
    return (match.group(1) or match.group(2) or "") if match else ""


def url_path(col):
    return F.regexp_extract(col, _PATH, 1)


def is_bad_url(col):
    """True for text that cannot be parsed as a URL at all."""
    tests = [_CONTROL, _BROKEN_ESCAPE, _BAD_PORT, _BAD_HOST, _NO_SCHEME]
    return col.rlike("|".join(f"(?:{test})" for test in tests))


def ends_with_gz(col):
    """The path ends in .gz in any case; unparsable text is tested whole."""
    path = F.coalesce(F.try_url_decode(url_path(col)), url_path(col))
    return F.lower(F.when(is_bad_url(col), col).otherwise(path)).endswith(".gz")
