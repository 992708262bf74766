from pyspark.sql import functions as F

from wareloom.functions.text import trim_unicode
from wareloom.functions.urls import is_bad_url, url_host

# url: (host, unparsable)
URLS = {
    "https://www.Example.com/a?b#c": ("www.Example.com", False),
    "http://u:p@h.com:8080/x": ("h.com", False),
    "https://[2001:db8::1]:443/": ("2001:db8::1", False),
    "https://under_score.com/a b": ("under_score.com", False),
    "//cdn.example.com/x": ("cdn.example.com", False),
    "https://h?q=1": ("h", False),
    "https://h#f": ("h", False),
    "/path/only": ("", False),
    "mailto:a@b.c": ("", False),
    "https:///x": ("", False),
    "": ("", False),
    "https://h/%zz": ("h", True),
    "https://h/%41": ("h", False),
    "https://h/?q=%zz": ("h", False),
    "https://h/#%zz": ("h", True),
    "https://h/a\x7f": ("h", True),
    "https://h:80a/": ("", True),
    "https://a b.com/": ("a b.com", True),
    ":x": ("", True),
}


def test_hosts_and_bad_urls(spark):
    rows = spark.createDataFrame([(u,) for u in URLS], "url string")
    got = {r.url: (r.host, r.bad) for r in rows.select("url", url_host(F.col("url")).alias("host"), is_bad_url(F.col("url")).alias("bad")).collect()}
    assert got == URLS


def test_trim(spark):
    rows = spark.createDataFrame([("　 \ta b\u0085\r\n",), ("x",)], "s string")
    assert [r.t for r in rows.select(trim_unicode(F.col("s")).alias("t")).collect()] == ["a b", "x"]
