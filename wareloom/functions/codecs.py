"""Content decoding for single bodies; runs inside Arrow batches."""

import zlib

from wareloom.fixed_values import CUT_OFF, EMPTY_INPUT, NOT_GZIP

PLAIN = "plain"
DECODED = "decoded"
PASSED = "passthrough"
FAILED = "error"
UNSUPPORTED = "unsupported"


class BadHeader(ValueError):
    """The bytes do not start like the announced format."""


def _gzip_header(data):
    if not data:
        raise ValueError(EMPTY_INPUT)
    if len(data) < 10:
        raise ValueError(CUT_OFF)
    if data[:3] != b"\x1f\x8b\x08":
        raise BadHeader(NOT_GZIP)


def gunzip(data):
    """All members of a gzip body; BadHeader when even the first one is not gzip."""
    out = []
    rest = data
    while rest or not out:
        try:
            _gzip_header(rest)
            member = zlib.decompressobj(wbits=31)
            out.append(member.decompress(rest))
        except BadHeader:
            if not out:
                raise
            raise ValueError(NOT_GZIP) from None
        except zlib.error as exc:
            if not out and "header" in str(exc):
                raise BadHeader(NOT_GZIP) from None
            raise ValueError(f"gzip: {exc}") from None
        if not member.eof:
            raise ValueError(CUT_OFF)
        rest = member.unused_data
    return b"".join(out)


def inflate(data):
    """A zlib body, else a raw deflate body, else None.

    Once the zlib header is right, later damage is an error rather than a reason to
    try the raw form.
    """
    head = data[:2]
    is_zlib = (
        len(head) == 2
        and head[0] & 0x0F == 8
        and head[0] >> 4 <= 7
        and int.from_bytes(head, "big") % 31 == 0
        and not head[1] & 0x20
    )
    stream = zlib.decompressobj(wbits=15 if is_zlib else -15)
    try:
        out = stream.decompress(data)
    except zlib.error as exc:
        if is_zlib:
            raise ValueError(f"zlib: {exc}") from None
        return None
    if stream.eof:
        return out
    if is_zlib:
        raise ValueError(CUT_OFF)
    return None


def decode_body(data, encodings):
    """(body, status, error) after undoing a comma list of encodings, last one first.

    A body with Brotli in its list stays undecoded as a whole, whatever else was undone.
    """
    status = PLAIN
    names = [name.strip() for name in encodings.split(",")]
    for name in reversed(names):
        try:
            if name == "gzip":
                data, status = gunzip(data), DECODED
            elif name == "deflate":
                raw = inflate(data)
                data, status = (data, PASSED) if raw is None else (raw, DECODED)
        except BadHeader:
            status = PASSED
        except ValueError as exc:
            return None, FAILED, str(exc)
    return data, UNSUPPORTED if "br" in names else status, None


def gunzip_body(data):
    """(body, status, error) of a file that must be gzip."""
    try:
        return gunzip(data), DECODED, None
    except ValueError as exc:
        return None, FAILED, str(exc)
