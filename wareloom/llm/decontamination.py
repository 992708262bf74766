"""Benchmark decontamination by template windows.

Numbers, names and units of a text are replaced with typed placeholders, so that a question asked
again with other values still has the same template. Five-word windows of the templates of the
benchmark are hash-joined with those of the documents. What the placeholders stood for has to be
consistent: a value of the question always turns into the same value of the document.

A template says nothing where a text is mostly values. So every item is also looked for as it is: windows
of its words, values included, and for an item shorter than a window all its words as one. An item with
few template windows matches by `percent` of these, any other by all of them.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wareloom.llm.common import run_tables
from wareloom.llm.shingles import mix, signed, span_hashes

WORDS = 5
PERCENT = 80
# A window with fewer words of its own says too little.
MIN_LITERALS = 3
# Bits of the filter that tells which document windows are worth a join; 2 MB whatever the benchmark.
FILTER_BITS = 1 << 24

# Units that may follow a number.
UNITS = (
    "%", "$", "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "ms", "h", "min", "kb", "mb", "gb",
    "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres",
    "kilometer", "kilometers", "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ounce", "ounces",
    "liter", "liters", "litre", "litres", "gallon", "gallons", "percent", "degree", "degrees", "second", "seconds",
    "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "cent", "cents", "dollar", "dollars", "euro", "euros",
)

_KEEP = np.frombuffer(
    bytes(
        b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 or b in b"%$" else 32
        for b in range(256)
    ),
    np.uint8,
)
_ENDERS = np.isin(np.arange(256), np.frombuffer(b".!?:;\"", np.uint8))
NUMBER, UNIT, NAME = (np.uint64(int.from_bytes(hashlib.blake2b(kind, digest_size=8).digest(), "little")) for kind in (b"number", b"unit", b"name"))


def _hash_words(words):
    data = " ".join(words).encode()
    starts, at = [], 0
    for word in words:
        starts.append(at)
        at += len(word.encode()) + 1
    starts = np.array(starts)
    return span_hashes(data, starts, starts + np.array([len(word.encode()) for word in words]))


_UNIT_HASHES = np.sort(_hash_words(UNITS))


MONEY = "$¢£¥€"
EXACT = np.frombuffer(hashlib.blake2b(b"exact", digest_size=64).digest(), np.uint64)
# Code points from and to: punctuation beyond ASCII, and scripts that put no blanks between words.
PUNCTUATION = ((0xA0, 0xBF), (0x2000, 0x206F), (0x3000, 0x3004), (0x3008, 0x3020), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20))
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def _bounds(raw):
    """(starts, ends, bytes) of the words; a character of a script without blanks is a word."""
    flat = _KEEP[raw]
    digit = (raw >= 48) & (raw <= 57)
    inner = np.flatnonzero(digit[:-2] & digit[2:] & ((raw[1:-1] == 44) | (raw[1:-1] == 46))) + 1 if len(raw) > 2 else []
    flat[inner] = raw[inner]
    cut = np.zeros(len(raw) + 1, bool)
    lead = np.flatnonzero(raw >= 0xC2)
    if len(lead):
        at = lambda shift: raw[np.minimum(lead + shift, len(raw) - 1)].astype(np.int64) & 63
        first = raw[lead].astype(np.int64)
        two, three = first < 0xE0, first < 0xF0
        size = np.where(two, 2, np.where(three, 3, 4))
        point = np.where(
            two, (first & 31) << 6 | at(1),
            np.where(three, (first & 15) << 12 | at(1) << 6 | at(2), (first & 7) << 18 | at(1) << 12 | at(2) << 6 | at(3)),
        )
        within = lambda ranges: np.logical_or.reduce([(point >= low) & (point <= high) for low, high in ranges])
        # Letters among the signs of Latin-1, and signs of money.
        blank = within(PUNCTUATION) & ~np.isin(point, (0xA2, 0xA3, 0xA5, 0xAA, 0xB5, 0xBA))
        for shift in range(4):
            flat[lead[blank & (size > shift)] + shift] = 32
        alone = within(UNSPACED)
        cut[lead[alone]] = cut[lead[alone] + size[alone]] = True
    solid = np.concatenate([[False], flat != 32, [False]])
    start = (solid[1:] & ~solid[:-1]) | (cut & solid[1:])
    end = (solid[:-1] & ~solid[1:]) | (cut & solid[:-1])
    return np.flatnonzero(start), np.flatnonzero(end), flat.tobytes()


def canonical(text):
    """(readings, words): hashes of the words as they are, and the readings (template words, values) of the text.

    Words are runs of letters, digits, % and $, lower-cased (A-Z); a point or comma between two digits is
    part of a number. One that starts with a digit, or with a sign of money before a digit, is a number,
    a unit word after a number is a unit. A capitalised word is a name inside a sentence in the first
    reading, anywhere in the second. In a template, placeholders are in place of typed words; values are
    what they were, 0 for a literal word.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends, data = _bounds(raw)
    if not len(starts):
        return [(np.empty(0, np.uint64),) * 2] * 2, np.empty(0, np.uint64)
    hashes = span_hashes(data, starts, ends)
    first = raw[starts]
    number = (first >= 48) & (first <= 57)
    for sign in MONEY:
        if sign in text:
            code = np.frombuffer(sign.encode(), np.uint8)
            for at in np.flatnonzero((first == code[0]) & (ends - starts > len(code))):
                after = starts[at] + len(code)
                number[at] |= (raw[starts[at] : after] == code).all() and 48 <= raw[after] <= 57
    after_number = np.concatenate([[False], number[:-1]])
    place = np.minimum(np.searchsorted(_UNIT_HASHES, hashes), len(_UNIT_HASHES) - 1)
    unit = after_number & (_UNIT_HASHES[place] == hashes)
    second = raw[np.minimum(starts + 1, len(raw) - 1)]
    capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    closed = np.concatenate([[0], np.cumsum(_ENDERS[raw])])
    fresh = np.concatenate([[True], closed[starts[1:]] > closed[ends[:-1]]])
    capital &= (ends - starts > 1) & ~number & ~unit
    readings = []
    for name in (capital & ~fresh, capital):
        values = np.where(number | unit | name, hashes | np.uint64(1), np.uint64(0))
        readings.append((np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, hashes))), values))
    return readings, hashes


def windows(template, values, words=WORDS, literals=MIN_LITERALS):
    """(places, hashes) of the template windows that have enough literal words."""
    n = len(template) - words + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    own = np.concatenate([[0], np.cumsum(values == 0)])
    places = np.flatnonzero(own[words:] - own[:-words] >= literals)
    return places, _keys(template, words)[places]


def _keys(hashes, words):
    """Hash of each run of `words` hashes."""
    n = len(hashes) - words + 1
    keys = np.zeros(n, np.uint64)
    for shift, factor in enumerate(mix(np.arange(words)) | np.uint64(1)):
        keys += hashes[shift : n + shift] * factor
    return mix(keys)


def exact_windows(hashes, lengths):
    """Hashes of the windows of the words themselves, of each length."""
    found = [_keys(hashes, length) ^ EXACT[length % len(EXACT)] for length in lengths if length <= len(hashes)]
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _template_rows(words, percent):
    def run(batches):
        for batch in batches:
            rows = []
            for item_id, text in zip(batch["item_id"], batch["text"]):
                readings, hashes = canonical(text or "")
                if not len(hashes):
                    continue
                # Equal templates whose values repeat in the same pattern are one template.
                ids = [_digest(t.tobytes() + np.unique(v, return_inverse=True)[1].astype(np.int64).tobytes()) for t, v in readings]
                template_id, counts = ids[1], []
                for nth, (reading_id, (template, values)) in enumerate(zip(ids, readings)):
                    places, keys = windows(template, values, words)
                    counts.append(len(places))
                    # The second reading has fewer literal words; too few windows of it say little.
                    if nth and (reading_id == ids[0] or 2 * len(places) < len(hashes) - words + 1):
                        continue
                    for place, key in zip(places.tolist(), signed(keys).tolist()):
                        rows.append((item_id, template_id, reading_id, place, key, signed(values[place : place + words]), len(places), percent, 0))
                # Few template windows: fewer than half of all.
                least = percent if 2 * counts[0] < len(hashes) - words + 1 or len(hashes) < words else 100
                length, reading_id = min(words, len(hashes)), _digest(b"exact" + hashes.tobytes())
                keys = np.unique(exact_windows(hashes, {length}))
                for place, key in enumerate(signed(keys).tolist()):
                    rows.append((item_id, template_id, reading_id, place, key, [], len(keys), least, length))
            yield pd.DataFrame(rows, columns=[part.split()[0] for part in TEMPLATES.split(", ")])

    return run


def _digest(data):
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


# A template is looked for in several readings; one found in `percent` of its windows is enough.
TEMPLATES = (
    "item_id bigint, template_id bigint, reading_id bigint, item_place bigint, window bigint, item_values array<bigint>, "
    "n_windows bigint, percent bigint, length bigint"
)


def benchmark_templates(benchmark, words=WORDS, percent=PERCENT):
    """Windows of the benchmark's templates, those of equal templates once, under the smallest item id.

    `length` is 0 for windows of templates, otherwise that of windows of the words themselves. Items
    without words or without an id have no windows and match nothing.
    """
    items = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).filter("item_id IS NOT NULL")
    rows = items.mapInPandas(_template_rows(words, percent), TEMPLATES)
    return rows.groupBy("template_id", "reading_id", "item_place", "window").agg(
        F.min_by(F.struct("item_id", "item_values", "n_windows", "percent", "length"), "item_id").alias("_t")
    ).select("template_id", "reading_id", "item_place", "window", "_t.*")


def _bits(batches):
    filled = np.zeros(FILTER_BITS // 8, np.uint8)
    for batch in batches:
        places = batch["window"].to_numpy(np.int64).view(np.uint64) & np.uint64(FILTER_BITS - 1)
        np.bitwise_or.at(filled, (places >> np.uint64(3)).astype(np.int64), np.left_shift(1, (places & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
    full = np.flatnonzero(filled)
    yield pd.DataFrame({"byte": full, "bits": filled[full].astype(np.int64)})


def window_filter(templates):
    """Bitmap of the windows that occur, of a fixed size, put together from those of all tasks."""
    rows = templates.select("window").mapInPandas(_bits, "byte bigint, bits bigint")
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in rows.groupBy("byte").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        bitmap[row["byte"]] = row["bits"]
    return bitmap


def _near(bits, places, keys):
    low = keys & np.uint64(FILTER_BITS - 1)
    near = (bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return places[near], keys[near]


HITS = "array<struct<place:bigint,window:bigint,doc_values:array<bigint>>>"


def _hits(bitmap, words, lengths):
    @F.pandas_udf(HITS)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = bitmap.value
        for batch in texts:
            rows = []
            for text in batch:
                readings, hashes = canonical(text or "")
                found = {}  # windows that both readings have count once
                for template, values in readings:
                    places, keys = _near(bits, *windows(template, values, words))
                    for p, k in zip(places.tolist(), signed(keys).tolist()):
                        found[p, k] = {"place": p, "window": k, "doc_values": signed(values[p : p + words]).tolist()}
                # Without values there is nothing to be consistent, so their places do not count.
                keys = exact_windows(hashes, lengths)
                keys = np.unique(_near(bits, keys, keys)[1])
                rows.append(list(found.values()) + [{"place": None, "window": k, "doc_values": []} for k in signed(keys).tolist()])
            yield pd.Series(rows)

    return found.asNondeterministic()


def text_key(text):
    return F.unhex(F.md5(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8")))


def leaks(docs, benchmark, percent=PERCENT, words=WORDS):
    """Matches (text_key, item_id, n_matched, n_windows) of texts and templates.

    Texts are known by their digest, so copies are matched once and rows need no id. A match has at
    least `percent` per cent of the windows of the template, from alignments with consistent values.
    """
    spark = docs.sparkSession
    tables = run_tables(docs, "decontamination")
    templates = tables.write(benchmark_templates(benchmark, words, percent), "templates")
    lengths = {row["length"] for row in templates.filter("length > 0").select("length").distinct().collect()}  # `words` at most
    bitmap = spark.sparkContext.broadcast(window_filter(templates))
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    hits = (
        texts.select(text_key(F.col("text")).alias("text_key"), _hits(bitmap, words, lengths)("text").alias("_hits"))
        .select("text_key", F.explode("_hits").alias("_hit"))
        .select("text_key", "_hit.*")
    )
    joined = tables.write(hits.distinct(), "hits").join(templates, "window")
    pairs = F.filter(
        F.zip_with("item_values", "doc_values", lambda a, b: F.struct(a.alias("item"), b.alias("doc"))),
        lambda pair: (pair["item"] != 0) | (pair["doc"] != 0),
    )
    aligned = joined.groupBy("text_key", "template_id", "reading_id", (F.col("place") - F.col("item_place")).alias("shift")).agg(
        F.min("item_id").alias("item_id"),
        F.max("n_windows").alias("n_windows"),
        F.max("percent").alias("percent"),
        F.collect_set("item_place").alias("places"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("values"),
    )
    # At one alignment a place of the template meets one word, so these arrays are as long as the template at most.
    consistent = F.size("values") == F.size(F.array_distinct(F.transform("values", lambda pair: pair["item"])))
    reading = ["text_key", "template_id", "reading_id", "item_id", "n_windows", "percent"]
    placed = aligned.filter(consistent).select(*reading, F.explode("places").alias("place"))
    found = placed.distinct().groupBy(*reading).agg(F.count("*").alias("n_matched"))
    found = found.filter(F.lit(100) * F.col("n_matched") >= F.col("percent") * F.col("n_windows"))
    best = F.max_by(F.struct("n_matched", "n_windows"), F.col("n_matched") / F.col("n_windows")).alias("_best")
    return found.groupBy("text_key", "template_id").agg(F.min("item_id").alias("item_id"), best).select("text_key", "item_id", "_best.*")


def find_contaminated(docs, benchmark, percent=PERCENT, words=WORDS):
    """Every document with `contaminated`, the number of matching templates and the least matching item id.

    Documents without words match nothing, and so does everything if the benchmark is empty. An item
    shorter than a window is found wherever its words follow each other, even a single one. Repeated rows and copies fare alike; null ids stay null. Extra columns are
    ignored; an empty table gives an empty result.
    """
    found = leaks(docs, benchmark, percent, words).groupBy("text_key").agg(
        F.count("*").alias("n_items"), F.min("item_id").alias("item_id"),
        F.max(F.col("n_matched") / F.col("n_windows")).alias("coverage"),
    )
    found = run_tables(docs, "decontamination").write(found, "found")
    rows = docs.select(F.col("doc_id").cast("bigint"), text_key(F.col("text")).alias("text_key"))
    return rows.join(found, "text_key", "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )


def drop_contaminated(docs, benchmark, percent=PERCENT, words=WORDS):
    """The documents that no benchmark item leaked into, with all their columns."""
    found = leaks(docs, benchmark, percent, words).select(F.col("text_key").alias("_key")).distinct()
    found = run_tables(docs, "decontamination").write(found, "found")
    return docs.withColumn("_key", text_key(F.col("text"))).join(found, "_key", "left_anti").drop("_key")
