"""Text expressions shared by the parsers and merges."""

from pyspark.sql import functions as F


def trim_unicode(col):
    """Strip every Unicode white-space character, not only blanks, from both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def empty_to_null(col):
    """Stored text columns hold NULL where the input was an empty string."""
    return F.nullif(col, F.lit(""))


def body_text(body):
    """Body bytes as text; invalid UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(body.cast("string"))
