"""Lookup joins that hold up when one key owns a large share of the rows."""

from pyspark.sql import functions as F

from wareloom.session import RunTables

HOT_KEY_ROWS = 1_000_000
HOT_KEYS = 10_000
SALTS = 64
SMALL_ROWS = 100_000


def lookup_join(left, right, key, how="inner", hot_rows=HOT_KEY_ROWS, salts=SALTS):
    """Join `left`, where keys repeat, with `right`, which has one row per key.

    Keys with more than `hot_rows` rows are spread over `salts` partitions and their
    single right row is repeated as often. At most HOT_KEYS keys are salted, the
    most frequent ones, which bounds the broadcast; each key beyond them holds less
    than one in HOT_KEYS rows, so it cannot overload a task. With `hot_rows` rows or
    fewer on the left there is nothing to salt. `left` is read more than once (at first
    only its key), so store it beforehand if it is expensive.
    """
    if left.select(key).count() <= hot_rows:
        return left.join(right, key, how)
    others = [name for name in left.columns if name != key] or [key]
    hot = (
        left.groupBy(key)
        .agg(F.count("*").alias("_rows"))
        .filter(F.col("_rows") > hot_rows)
        .orderBy(F.desc("_rows"), key)
        .limit(HOT_KEYS)
        .select(key, F.lit(True).alias("_hot"))
    )
    hot = F.broadcast(hot)
    spread = F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int")
    salted_left = (
        left.join(hot, key, "left")
        .withColumn("_salt", F.when(F.col("_hot") | F.col(key).isNull(), spread).otherwise(F.lit(0)))
        .drop("_hot")
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_right = right.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")


def latest_rows(stored, key, tables, name, order=("batch_id", "seq")):
    """Of the rows of each key in a stored table those with the highest `order`, one if that is free of ties.

    Which rows are superseded is found from key and order alone and written; as a rule there are few or
    none, and then no wide row moves.
    """
    own = F.struct(*order)
    last = stored.groupBy(key).agg(F.count("*").alias("_n"), F.max(own).alias("_last")).filter("_n > 1")
    last = tables.write(last.select(F.col(key).alias("_key"), "_last"), f"{name}-repeated")
    if last.isEmpty():
        return stored
    older = stored.select(key, *order).join(last, F.col(key) == F.col("_key")).filter(own != F.col("_last"))
    older = tables.write(older.select("_key", *[F.col(c).alias(f"_{c}") for c in order]), f"{name}-superseded")
    same = [F.col(key) == F.col("_key"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in order]]
    return tables.write(stored.join(older, same, "left_anti"), f"{name}-latest")


def known_keys(rows, known, key):
    """The keys of `known` (one row per key) that `rows` has; few rows are broadcast and `known` is only scanned."""
    return known.select(key).join(rows.select(key), key, "left_semi")


def missing_rows(rows, known, key):
    """Rows whose key `known` (one row per key) does not have.

    The known keys among the rows are found first: when the rows are few, they are
    broadcast and a large `known` is only scanned. A direct anti join would have to
    shuffle it. `rows` is read twice.
    """
    return rows.join(known_keys(rows, known, key), key, "left_anti")


def small_or_lookup_join(left, right, key, how="inner", small_rows=SMALL_ROWS, tables=None):
    """Broadcast `right` when its stored table has few rows, else `lookup_join`."""
    tables = tables or RunTables(left.sparkSession, "lookup")
    stored = tables.write(right, "right")
    if stored.count() <= small_rows:
        return left.join(F.broadcast(stored), key, how)
    return lookup_join(left, stored, key, how)
