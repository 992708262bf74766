import gzip
import zlib

import pyarrow as pa

from conftest import SF
from wareloom.functions import codecs
from wareloom.operators import decode
from wareloom.operators.decode import decode_captures, gunzip_sitemaps
from wareloom.operators.sitemaps import parse_sitemaps
from wareloom.sources import derived

PAGE = b"<html>ok</html>"


def raw_deflate(data):
    packer = zlib.compressobj(wbits=-15)
    return packer.compress(data) + packer.flush()


GZ = gzip.compress(PAGE)
# name: (body, encoding, decoded body, status, error)
BODIES = {
    "gzip": (GZ, "gzip", PAGE, "decoded", None),
    "upper-case": (GZ, " GZip ", PAGE, "decoded", None),
    "plain-under-gzip": (b"<html>already decoded</html>", "gzip", b"<html>already decoded</html>", "passthrough", None),
    "members": (GZ + GZ, "gzip", PAGE + PAGE, "decoded", None),
    "cut-off": (GZ[:-6], "gzip", None, "error", "unexpected EOF"),
    "empty-under-gzip": (b"", "gzip", None, "error", "EOF"),
    "short-under-gzip": (b"abc", "gzip", None, "error", "unexpected EOF"),
    "garbage-after-member": (GZ + b"garbage-garbage", "gzip", None, "error", "gzip: invalid header"),
    "zlib": (zlib.compress(PAGE), "deflate", PAGE, "decoded", None),
    "raw": (raw_deflate(PAGE), "deflate", PAGE, "decoded", None),
    "plain-under-deflate": (PAGE, "deflate", PAGE, "passthrough", None),
    "cut-off-zlib": (zlib.compress(PAGE)[:-2], "deflate", None, "error", "unexpected EOF"),
    "cut-off-raw": (raw_deflate(PAGE)[:-2], "deflate", raw_deflate(PAGE)[:-2], "passthrough", None),
    "both": (gzip.compress(zlib.compress(PAGE)), "deflate, gzip", PAGE, "decoded", None),
    "wrong-order": (gzip.compress(zlib.compress(PAGE)), "gzip, deflate", zlib.compress(PAGE), "decoded", None),
    "brotli": (b"\x0b\x02\x80", "br", b"\x0b\x02\x80", "unsupported", None),
    "unknown": (PAGE, "zstd", PAGE, "plain", None),
    "empties": (GZ, ",, gzip,", PAGE, "decoded", None),
    "none": (PAGE, "", PAGE, "plain", None),
    "null": (PAGE, None, PAGE, "plain", None),
    "no-body": (None, "gzip", None, "plain", None),
}


def as_bytes(value):
    return None if value is None else bytes(value)


def test_content_encodings(captures):
    rows = decode_captures(captures(*[dict(url=n, body=b[0], content_encoding=b[1]) for n, b in BODIES.items()]))
    got = {r.url: (as_bytes(r.body), r.decode_status, r.fetch_error) for r in rows.collect()}
    assert got == {name: b[2:] for name, b in BODIES.items()}


def test_large_bodies_leave_in_slices(captures):
    big = gzip.compress(b"x" * (40 << 20))
    rows = decode_captures(captures(*[dict(url=str(i), body=big, content_encoding="gzip") for i in range(3)]))
    assert [r.n for r in rows.selectExpr("length(body) AS n").collect()] == [40 << 20] * 3


def test_sitemap_files(captures):
    text = b"<urlset/>"
    cases = {
        "https://h/a.xml.gz": (gzip.compress(text), "", "", "decoded"),
        "https://h/a.XML.GZ?v=1": (gzip.compress(text), "", "", "decoded"),
        "https://h/a.g%7A#x": (gzip.compress(text), "", "", "decoded"),
        "https://h/typed": (gzip.compress(text), "Application/X-GZIP", "", "decoded"),
        "https://h/encoded.gz": (text, "application/gzip", "GZIP", "plain"),
        "https://h/query?f=a.gz": (text, "", "", "plain"),
        "https://h.gz": (text, "", "", "plain"),
        "https://h/not-gzip.gz": (text, "", "", "error"),
        "bad%zz.gz": (gzip.compress(text), "", "", "decoded"),
    }
    rows = captures(*[dict(url=u, body=c[0], content_type=c[1], content_encoding=c[2]) for u, c in cases.items()])
    unpacked = gunzip_sitemaps(rows)
    assert {r.url: r.decode_status for r in unpacked.collect()} == {u: c[3] for u, c in cases.items()}
    failed = {r.url: r.error for r in parse_sitemaps(unpacked).collect() if r.status == "failed"}
    assert failed == {"https://h/not-gzip.gz": "unexpected EOF"}


def test_bodies_are_packed_and_decoded_in_slices():
    """A worker holds the batch it is given and some MB besides, not all its bodies once more."""
    bodies = [bytes([i]) * (1 << 20) for i in range(40)]
    plain = pa.array([*bodies, None], pa.binary())
    for forms in (["gzip"] * 41, ["none"] * 41, [None] * 41):
        packed = list(derived._packed(iter([(plain, pa.array(["none"] * 41), pa.array(forms, pa.string()))])))
        assert max(part.nbytes for part in packed) < 10 << 20
        decoded = list(decode._decoder(codecs.decode_body).func(iter([(part, pa.array(["gzip"] * len(part))) for part in packed])))
        assert max(part.nbytes for part in decoded) < 10 << 20
        rows = [row for part in decoded for row in part.to_pylist()]
        assert [row["body"] for row in rows] == [*bodies, None]
        assert {row["decode_status"] for row in rows[:40]} == {"decoded" if forms[0] == "gzip" else "passthrough"}


def test_bodies_pass_through_python_twice(spark):
    """Once to be packed in all forms, once to be decoded; neither by way of pandas."""
    plan = decode_captures(derived.packed_captures(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2


def test_pages_without_html(spark, run_dir):
    rows = [(0, "a", None), (4, "b", "<p>"), (5, "c", None), (5, "d", "<p>"), (2, "e", "")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{run_dir}/pages.parquet")
    got = {r.url: as_bytes(r.body) for r in decode_captures(derived.packed_captures(spark, run_dir)).collect()}
    assert got == {"a": None, "b": b"<p>", "c": None, "d": b"<p>", "e": b""}
