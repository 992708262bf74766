"""Quality rules: word statistics and compression bands.

A text is compressed with zstandard as a whole and in fixed chunks. Text that repeats itself
compresses too well, noise hardly at all; what is normal depends on the length, so each length
class has a band of its own. Fixed bands hold for every corpus. Within them, each class of a quarter
octave of bytes has limits derived from all documents: the median of log ratios and WIDTH spreads on
either side of it. The spread is taken from the quartile nearer to the median, since junk widens one
side. Classes with fewer than LEAST members have the fixed bands alone.
"""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import functions as F

from wareloom.llm.common import SPACES, ship_code, words_of

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3

# (texts of at least so many bytes, lowest ratio, highest ratio) of bytes to compressed bytes.
BANDS = (
    (0, 0.0, 2.2),
    (128, 0.95, 2.6),
    (256, 1.05, 2.6),
    (512, 1.15, 2.7),
    (1024, 1.25, 2.8),
    (2048, 1.40, 3.0),
    (4096, 1.50, 3.2),
    (8192, 1.55, 3.5),
    (16384, 1.55, 4.0),
    (1 << 20, 1.55, 5.0),
)
CHUNK_BYTES = 1024
CHUNK_BAND = (1.25, 2.7)
MAX_BAD_CHUNKS = 1 / 3
LEVEL = 1
# Derived limits: spreads on either side of the median, members a class needs, least spread of log ratios.
WIDTH = 4.0
LEAST = 50
MIN_SPREAD = 0.01
# Log ratios are counted in steps of 1/STEPS.
STEPS = 500
TEXT, CHUNK = 0, 1

RESULT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, ratio double, n_chunks bigint, n_bad_chunks bigint"
)
_NAMES = [part.split()[0] for part in RESULT.split(", ")]


def repeated_words(words, window=WINDOW):
    """Words lying in a window of `window` words that the text has more than once."""
    if len(words) <= window:
        return 0
    number = {}
    ids = np.fromiter((number.setdefault(word, len(number)) for word in words), np.int64, len(words))
    if len(number) ** window < 2**62:
        keys = ids[: len(ids) - window + 1].copy()
        for shift in range(1, window):
            keys = keys * len(number) + ids[shift : len(ids) - window + 1 + shift]
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        often = counts[inverse] > 1
    else:
        keys = list(zip(*(ids[shift:].tolist() for shift in range(window))))
        counts = Counter(keys)
        often = np.fromiter((counts[key] > 1 for key in keys), bool, len(keys))
    covered = np.zeros(len(ids), bool)
    for shift in range(window):
        covered[shift : len(covered) - window + 1 + shift] |= often
    return int(covered.sum())


def duplicate_lines(text):
    """Lines with a word that equal an earlier line."""
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if line in seen:
            repeated += 1
        elif line.strip(SPACES.decode()):
            seen.add(line)
    return repeated


def band_for(size, bands=BANDS):
    return next((low, high) for least, low, high in reversed(bands) if size >= least)


def length_class(size):
    return int(4 * math.log2(size))


def chunks_of(data, compressor, chunk_bytes=CHUNK_BYTES):
    """(bytes, ratio) of each chunk, the last one as short as it is."""
    view = memoryview(data)
    for start in range(0, len(data), chunk_bytes):
        size = min(chunk_bytes, len(data) - start)
        yield size, size / len(compressor.compress(view[start : start + size]))


def compression(data, compressor, limits=None, bands=BANDS, chunk_bytes=CHUNK_BYTES, chunk_band=CHUNK_BAND):
    """(ratio of the whole, inside its limits, chunks, chunks outside theirs, bytes of these)."""
    if not data:
        return 0.0, False, 0, 0, 0
    limits = limits or {}
    ratio = len(data) / len(compressor.compress(data))
    low, high = band_for(len(data), bands)
    least, most = limits.get((TEXT, length_class(len(data))), (low, high))
    chunks = bad = bad_bytes = 0
    for size, chunk in chunks_of(data, compressor, chunk_bytes):
        below, above = chunk_band if size == chunk_bytes else band_for(size, bands)
        lower, upper = limits.get((CHUNK, length_class(size)), (below, above))
        out = not max(below, lower) <= chunk <= min(above, upper)
        chunks += 1
        bad += out
        bad_bytes += size * out
    return ratio, max(low, least) <= ratio <= min(high, most), chunks, bad, bad_bytes


def _counted(batches):
    compressor, seen = zstandard.ZstdCompressor(level=LEVEL), Counter()
    for batch in batches:
        for text in batch["text"]:
            data = (text or "").encode("utf-8", "surrogatepass")
            if not data:
                continue
            whole = (len(data), len(data) / len(compressor.compress(data)))
            seen[TEXT, length_class(len(data)), round(STEPS * math.log(whole[1]))] += 1
            for size, ratio in chunks_of(data, compressor):
                seen[CHUNK, length_class(size), round(STEPS * math.log(ratio))] += 1
    yield pd.DataFrame([(*key, n) for key, n in seen.items()], columns=["kind", "class", "step", "n"]).astype("int64")


def derive_limits(docs):
    """{(text or chunk, length class): (lowest, highest ratio)} from all documents.

    Tasks count ratios by class and step, so what they return is as small for any corpus.
    """
    ship_code(docs.sparkSession)
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(_counted, "kind bigint, class bigint, step bigint, n bigint")
    quartiles = counted.groupBy("kind", "class", "step").agg(F.sum("n").alias("n")).groupBy("kind", "class").agg(
        F.sum("n").alias("n"), F.percentile("step", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("at")
    )
    limits = {}
    for row in quartiles.filter(F.col("n") >= LEAST).collect():
        low, middle, high = (step / STEPS for step in row["at"])
        spread = max(MIN_SPREAD, min(middle - low, high - middle) / 0.6745)
        limits[row["kind"], row["class"]] = math.exp(middle - WIDTH * spread), math.exp(middle + WIDTH * spread)
    return limits


def judge(text, compressor, limits=None):
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = words_of(text)
    repeated = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * len(words)
    ratio, inside, chunks, bad, bad_bytes = compression(data, compressor, limits)
    return (
        len(words),
        len(text) - (len(data) - len(data.translate(None, SPACES))),
        len(data) - len(data.translate(None, SYMBOLS)),
        duplicate_lines(text),
        repeated,
        failed,
        not failed and inside and bad_bytes <= MAX_BAD_CHUNKS * len(data),
        ratio,
        chunks,
        bad,
    )


def judged(text, limits=None):
    """A column with statistics and verdict of each text."""

    def judge_all(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in texts:
            yield pd.DataFrame([judge(text, compressor, limits) for text in batch], columns=_NAMES)

    udf = F.pandas_udf(judge_all, RESULT).asNondeterministic()  # so that it runs once, whatever reads its fields
    return udf(text)


def quality_rules(docs, corpus=None):
    """Statistics and verdict per document, by limits of `corpus` or else of the documents themselves.

    Both passes are map-only but for the counts of ratios. No text, an empty text and one without words
    have no words, fail the base rules and are not kept. Repeated rows are judged one by one, equal texts
    alike. A null doc_id stays null. Extra columns are ignored. An empty table gives an empty result.
    """
    limits = derive_limits(docs if corpus is None else corpus)
    rows = docs.select(F.col("doc_id").cast("bigint"), judged(F.col("text").cast("string"), limits).alias("_q"))
    return rows.select("doc_id", "_q.*")


def keep_good(docs, corpus=None):
    """The documents the rules keep, with all their columns."""
    limits = derive_limits(docs if corpus is None else corpus)
    return docs.withColumn("_quality", judged(F.col("text").cast("string"), limits)).filter("_quality.kept").drop("_quality")
