"""License scans: MinHash bands of overlapping text windows retrieve templates, exact shingles verify them.

Texts and templates are cut into lower-cased words of letters and digits, and hashed in five-word
shingles. A window is a run of eight shingles, one every four; its signature is the least value under
each of four hash functions, a band each. A stretch that agrees with a template in eleven
shingles in a row holds a whole window of it, which collides for certain; one edited elsewhere has
many more chances, since windows with half their shingles in common collide with probability
1 - 0.5 ** 4. Templates too short for windows use windows of one shingle, which collide exactly when
they agree. Retrieved templates are verified on the five-word shingles themselves.
Everything is built from DataFrame functions.
"""

from pyspark.sql import functions as F

from wareloom.llm.common import run_tables

WORDS = 5
WINDOW, STEP, HASHES = 8, 4, 4
PERCENT = 80
# Up to so many band values a scan is narrowed by a literal set; beyond it, bands are joined unfiltered.
LITERAL_BANDS = 20_000

# Notices as licences ask for them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "MIT-grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so",
    ),
    (
        "Apache-2.0-header",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "BSD-redistribution",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer.",
    ),
    (
        "GPL-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text):
    """Runs of a-z and 0-9 after lower-casing A-Z."""
    flat = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(flat, "[^a-z0-9]+"), lambda word: word != "")


def shingles(words, size=WORDS):
    """Distinct shingles as text."""
    n = F.size(words) - (size - 1)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice(words, i, F.lit(size)), " ")))


def with_shingle_hashes(df, words, size=WORDS):
    """Adds `_s`: a hash per shingle, in order; built in two steps so that each word is hashed once."""
    hashed = df.withColumn("_h", F.transform(words, lambda word: F.xxhash64(word)))
    n = F.size("_h") - (size - 1)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return hashed.withColumn(
        "_s", F.transform(places, lambda i: F.xxhash64(*[F.get("_h", i + shift) for shift in range(size)]))
    ).drop("_h")


def with_bands(df, step, window=WINDOW, hashes=HASHES):
    """Adds `_bands`: for each window of `_s`, its least value under each hash function, marked with the function."""
    names = [f"_s{k}" for k in range(hashes)]
    for k, name in enumerate(names):
        df = df.withColumn(name, _salted("_s", k))
    last = F.greatest(F.size("_s") - (window - 1), F.lit(1))
    places = F.when(F.size("_s") > 0, F.sequence(F.lit(1), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_w", places)
    return df.withColumn("_bands", F.concat(*[_least(name, window) for name in names])).drop("_w", *names)


def _salted(hashes, k):
    return F.transform(hashes, lambda x: F.xxhash64(x, F.lit(k)))


def _least(hashes, window):
    return F.transform("_w", lambda place: F.array_min(F.slice(hashes, place, F.lit(window))))


def template_rows(spark, templates=TEMPLATES):
    """(license, wanted): the distinct shingles of each template; those without any are left out."""
    rows = spark.createDataFrame(list(templates), "license string, text string")
    return (
        rows.filter(F.col("license").isNotNull())
        .select("license", words_of(F.col("text")).alias("words"))
        .select("license", "words", shingles(F.col("words")).alias("wanted"))
        .filter(F.size("wanted") > 0)
    )


def template_bands(templates, window=WINDOW, step=STEP):
    """(license, band, short): bands of the windows at every place; single shingles of templates too short for them."""
    hashed = with_shingle_hashes(templates.select("license", "words"), F.col("words"))
    enough = F.size("_s") >= window + step - 1
    long = with_bands(hashed.filter(enough), 1).select("license", F.explode("_bands").alias("band"), F.lit(False).alias("short"))
    short = hashed.filter(~enough).select("license", F.explode("_s").alias("band"), F.lit(True).alias("short"))
    return long.union(short).distinct()


def literal_bands(bands):
    """The distinct band values in order; None when they are too many for a literal."""
    rows = bands.select("band").distinct().limit(LITERAL_BANDS + 1).collect()
    return sorted(row["band"] for row in rows) if len(rows) <= LITERAL_BANDS else None


def _among(bands, values):
    """The bands among the given values; all of them when there is no list of values."""
    if values is None:
        return F.array_distinct(bands)
    return F.array_intersect(bands, F.array(*[F.lit(v) for v in values]).cast("array<bigint>"))


def text_key(text):
    return F.unhex(F.md5(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8")))


def scan_licenses(docs, templates=TEMPLATES, percent=PERCENT):
    """A row for each document and template of which it has at least `percent` per cent of the shingles.

    Documents without text or with fewer than five words have no row, and templates as short are never
    found. Repeated rows have their rows each; a null doc_id stays null. Extra columns are ignored;
    empty tables give an empty result.
    """
    spark = docs.sparkSession
    tables = run_tables(docs, "licenses")
    known = tables.write(template_rows(spark, templates), "templates")
    bands = tables.write(template_bands(known), "bands")
    long_values, short_values = (literal_bands(bands.filter(which)) for which in (~F.col("short"), F.col("short")))

    keyed = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    texts = keyed.filter("text IS NOT NULL").select(text_key(F.col("text")).alias("text_key"), words_of(F.col("text")).alias("words"))
    hashed = with_bands(with_shingle_hashes(texts, F.col("words")), STEP)
    # Short templates are looked up by single shingles, long ones by the bands of windows.
    seen = F.array_distinct(F.concat(_among(F.col("_s"), short_values), _among(F.col("_bands"), long_values)))
    hits = hashed.select("text_key", F.explode(seen).alias("band")).join(bands.select("license", "band"), "band")
    retrieved = tables.write(hits.select("text_key", "license").distinct(), "retrieved")

    wanted_texts = keyed.withColumn("text_key", text_key(F.col("text"))).join(retrieved.select("text_key").distinct(), "text_key", "left_semi")
    words = wanted_texts.select("doc_id", "text_key", words_of(F.col("text")).alias("words"))
    owned = words.select("doc_id", "text_key", shingles(F.col("words")).alias("owned"))
    found = F.size(F.array_intersect("wanted", "owned"))
    return (
        owned.join(retrieved, "text_key")
        .join(known.select("license", "wanted"), "license")
        .select("doc_id", "license", F.size("wanted").cast("bigint").alias("n_shingles"), found.cast("bigint").alias("n_found"))
        .filter(F.lit(100) * F.col("n_found") >= F.lit(percent) * F.col("n_shingles"))
    )
