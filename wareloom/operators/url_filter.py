"""A Bloom filter of stored URLs as a table of bitmaps whose size does not depend on how many there are.

2,048 bitmaps of 32,768 bits, 8 MB in all, so it may be broadcast whatever the state holds. A URL sets
HASHES bits. Where one of a URL's bits is not set, the URL is not stored; where all are, it may be, and
an exact join has to tell. The fuller the filter, the more URLs go that way; none is ever lost.
"""

from pyspark.sql import functions as F

BITMAP_BITS = 32_768
BITMAPS = 2_048
HASHES = 4


def _bits(rows, key):
    """Rows (key, bitmap_id, bit): the bits of each key."""
    places = [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BITMAPS * BITMAP_BITS)) for i in range(HASHES)]
    placed = rows.select(key, F.explode(F.array(*places)).alias("_place"))
    return placed.select(
        key, F.expr(f"_place div {BITMAP_BITS}").alias("bitmap_id"), (F.col("_place") % BITMAP_BITS).cast("int").alias("bit")
    )


def url_filter(rows, key="url"):
    """The filter (bitmap_id, bitmap) of all keys; every task sends on at most one bitmap of each id."""
    return _bits(rows, key).groupBy("bitmap_id").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def possible_keys(rows, known, key="url"):
    """The distinct keys of `rows` that the filter `known` may hold."""
    bits = _bits(rows.select(key).distinct(), key)
    is_set = F.expr("(shiftright(cast(conv(hex(substring(bitmap, bit div 8 + 1, 1)), 16, 10) AS int), bit % 8) & 1) = 1")
    looked_up = bits.join(F.broadcast(known), "bitmap_id", "left").select(key, F.coalesce(is_set, F.lit(False)).alias("_set"))
    return looked_up.groupBy(key).agg(F.bool_and("_set").alias("_all")).filter("_all").select(key)
