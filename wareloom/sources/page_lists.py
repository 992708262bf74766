"""Page-list exports: JSON arrays cut into byte ranges at the borders of their elements.

Spark's text reader cuts a file of any size into ranges and records, here at each closing brace, on any
file system. Whether a brace ends an element depends on everything before it, so one pass works out, per
range, what it does to the nesting for either way it may start, inside a string or not. These few rows
fix how each range starts; a second pass then takes the elements out, ranges side by side.
"""

import json
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from wareloom.schemas import PAGE_LIST

# Workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_END = "}"
_ESCAPE = re.compile(r"\\.", re.DOTALL)
# What may stand before the first element, between two, after the last, and in an array without any.
_FIRST = re.compile(r"\s*\[\s*(?:null\s*,\s*)*\Z")
_BETWEEN = re.compile(r"\s*,\s*(?:null\s*,\s*)*\Z")
_AFTER = re.compile(r"(?:\s*,\s*null\s*)*\s*\]\s*\Z")
_EMPTY = re.compile(r"\s*\[\s*(?:null\s*(?:,\s*null\s*)*)?\]\s*\Z")


class MalformedArray(ValueError):
    def __init__(self, file):
        super().__init__(f"MALFORMED_RECORD: {file} is not an array of objects")


def _nesting(text, inside):
    """(inside a string at the end, change of depth) of a piece of JSON text."""
    parts = _ESCAPE.sub("", text).split('"')
    outside = parts[1::2] if inside else parts[0::2]
    depth = sum(part.count("{") + part.count("[") - part.count("]") for part in outside)
    return inside ^ (len(parts) % 2 == 0), depth


def _ranges(batches):
    """(file, start of range, its records) of the records a task reads, in order."""
    key, records = None, []
    for batch in batches:
        for *place, text in zip(*(column.to_pylist() for column in batch.columns)):
            if place != key:
                if records:
                    yield (*key, records)
                key, records = place, []
            records.append(text)
    if records:
        yield (*key, records)


def _summaries(batches):
    """For either start of a range: how it ends, its change of depth, and the closings at each depth."""
    rows = []
    for file, start, records in _ranges(batches):
        ways = []
        for inside in (False, True):
            depth, closings, before_last = 0, {}, None
            for text in records:
                before_last = (inside, depth)
                inside, change = _nesting(text, inside)
                depth += change
                if not inside:
                    depth -= 1
                    closings[depth] = closings.get(depth, 0) + 1
            ways.append({"inside": inside, "depth": depth, "closings": closings, "before_last": before_last})
        rows.append((file, start, json.dumps(ways)))
    if rows:
        yield pa.record_batch([pa.array(column) for column in zip(*rows)], names=["file", "start", "ways"])


def _starts(summaries):
    """How each range starts, from those before it: {(file, start): (inside, depth, elements before, last range)}."""
    found, file = {}, None
    ordered = sorted(summaries, key=lambda row: (row[0], row[1]))
    for place, (name, start, ways) in enumerate(ordered):
        if name != file:
            file, inside, depth, number = name, False, 0, 0
        last = place + 1 == len(ordered) or ordered[place + 1][0] != name
        found[name, start] = (inside, depth, number, last)
        way = json.loads(ways)[inside]
        number += way["closings"].get(str(1 - depth), 0)
        inside, depth = way["inside"], depth + way["depth"]
    return found


def _elements(starts):
    """Takes elements, or parts of those that go on in other ranges, out of the records of a task."""

    def take(batches):
        for file, start, records in _ranges(batches):
            inside, depth, number, last = starts[file, start]
            rows, held, cut = [], [], depth > 1
            for place, text in enumerate(records):
                ends_file = last and place + 1 == len(records)
                if depth <= 1 and not held:
                    # Between elements, where a record begins with what stands before the next one.
                    if ends_file:
                        if not (_AFTER if depth else _EMPTY).match(text):
                            raise MalformedArray(file)
                        continue
                    brace = text.find("{")
                    if brace < 0 or not (_BETWEEN if depth else _FIRST).match(text[:brace]):
                        raise MalformedArray(file)
                    depth, text = 1, text[brace:]
                elif ends_file:
                    raise MalformedArray(file)
                inside, change = _nesting(text, inside)
                depth += change - (not inside)
                held.append(text + _END)
                if depth <= 1 and not inside:
                    rows.append((file, number, start, cut, "".join(held)))
                    held, cut, number = [], False, number + 1
            if held:
                rows.append((file, number, start, True, "".join(held)))
            if rows:
                names = ["file", "number", "start", "cut", "text"]
                yield pa.record_batch([pa.array(column) for column in zip(*rows)], names=names)

    return take


def read_array(spark, path):
    """Elements (number, page) of JSON arrays, one per file; `number` is the place in its `file`.

    An element that lies across ranges is put together from its parts. Anything but an array of objects
    or nulls is an error; null elements are left out and not numbered.
    """
    text = spark.read.option("lineSep", _END).text(path)
    records = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    # One row per byte range reaches the driver.
    summaries = records.mapInArrow(_summaries, "file string, start bigint, ways string").collect()
    taken = records.mapInArrow(_elements(_starts(summaries)), "file string, number bigint, start bigint, cut boolean, text string")
    whole = taken.filter(~F.col("cut")).select("file", "number", "text")
    parts = taken.filter("cut").groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("parts"))
    joined = parts.select("file", "number", F.array_join(F.transform("parts", lambda part: part["text"]), "").alias("text"))
    return whole.unionByName(joined).select("file", "number", F.from_json("text", PAGE_LIST, {"mode": "FAILFAST"}).alias("page"))
