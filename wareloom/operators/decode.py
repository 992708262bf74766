"""Undo content encodings of captured bodies."""

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from wareloom.functions import codecs
from wareloom.functions.urls import ends_with_gz

# Workers may not have the package installed, so the helper travels with the job.
cloudpickle.register_pickle_by_value(codecs)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_DECODED = "body binary, decode_status string, error string"
_SLICE_BYTES = 8 << 20


def _slices(results):
    """Group results into arrays of bounded size; one body can inflate a lot."""

    def array():
        bodies, *texts = zip(*rows)
        return pa.StructArray.from_arrays(
            [pa.array(bodies, pa.binary()), *(pa.array(text, pa.string()) for text in texts)],
            ["body", "decode_status", "error"],
        )

    rows, size = [], 0
    for row in results:
        rows.append(row)
        size += len(row[0] or b"")
        if size >= _SLICE_BYTES:
            yield array()
            rows, size = [], 0
    if rows:
        yield array()


def _decoder(one):
    """Iterator UDF over (body, argument); rows with a NULL body are left alone.

    It works on Arrow arrays, one body at a time: a worker holds a batch, at most 64 MB as Spark cuts
    them, and a slice, but no second copy of either.
    """

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for bodies, arguments in batches:
            yield from _slices(
                one(body.as_py(), argument.as_py()) if body.is_valid else (None, None, None)
                for body, argument in zip(bodies, arguments)
            )
            # Nothing of this batch is kept while the next one is read.
            del bodies, arguments
            pa.default_memory_pool().release_unused()

    # Not deterministic as far as the optimizer knows: a filter on decoded columns
    # would otherwise be pushed below and decode everything a second time.
    return F.arrow_udf(run, _DECODED).asNondeterministic()


def decode_captures(captures):
    """Undo `content_encoding`, right to left over its comma list.

    Only bodies that need work are handed to Python: the others travel as NULL, so
    one scan serves both kinds and nothing is read twice. A wrong gzip magic passes
    the body through, a damaged stream sets `fetch_error`. Brotli has no codec here
    and is flagged `unsupported`.
    """
    encodings = F.lower(F.coalesce("content_encoding", F.lit("")))
    needed = F.col("body").isNotNull() & encodings.rlike(r"(?U)(?:^|,)\s*(?:gzip|deflate)\s*(?:,|$)")
    native = F.when(encodings.rlike(r"(?U)(?:^|,)\s*br\s*(?:,|$)"), F.lit("unsupported")).otherwise(F.lit("plain"))
    return _apply(captures, _decoder(codecs.decode_body), needed, encodings, native)


def gunzip_sitemaps(captures):
    """Unpack sitemap files that are themselves gzip.

    Not when the transport already announced gzip; yes when the content type says
    gzip or the URL path ends in .gz. Here a body that is not gzip is an error.
    """
    transport = F.lower(F.coalesce("content_encoding", F.lit("")))
    media = F.lower(F.coalesce("content_type", F.lit("")))
    needed = (
        F.col("body").isNotNull()
        & F.col("status_code").between(200, 299)
        & ~transport.contains("gzip")
        & (media.contains("gzip") | ends_with_gz(F.col("url")))
    )
    return _apply(captures, _decoder(lambda body, _: codecs.gunzip_body(body)), needed, F.lit(""), F.lit("plain"))


def _apply(captures, decoder, needed, argument, native_status):
    keep = [name for name in captures.columns if name not in ("body", "fetch_error", "decode_status")]
    earlier = F.col("decode_status") if "decode_status" in captures.columns else native_status
    marked = captures.withColumn("_needed", F.coalesce(needed, F.lit(False)))
    decoded = marked.withColumn("_out", decoder(F.when(F.col("_needed"), F.col("body")), argument))
    return decoded.select(
        *keep,
        F.when(F.col("_needed"), F.col("_out.body")).otherwise(F.col("body")).alias("body"),
        F.coalesce("fetch_error", "_out.error").alias("fetch_error"),
        F.when(F.col("_needed"), F.col("_out.decode_status")).otherwise(earlier).alias("decode_status"),
    )
