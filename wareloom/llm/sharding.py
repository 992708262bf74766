"""Sharding by best-fit-decreasing bin packing of indivisible groups of equal texts.

Documents with equal text form a group that no shard boundary may cut. Groups too large for a
pallet (a 1/256 of a shard) are at most 16 * 256; they are packed as they are. All others are
first packed, best fit decreasing, into pallets of that capacity by many tasks at once. What is
left to pack into shards is then a few thousand items whatever the size of the corpus: best fit
decreasing again, with the smallest capacity for which the given number of shards suffices.
"""

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from wareloom.llm.common import run_tables, shuffle_partitions

SHARDS = 16
PALLETS_PER_SHARD = 256
_NODE = 256


class CapacityTree:
    """Bins ordered by (remaining capacity, bin) in a balanced tree of height two.

    Nodes are split when they are full and dropped when empty, so that every operation touches
    one node, found by bisection.
    """

    def __init__(self):
        self.nodes = []
        self.tops = []

    def add(self, room, place):
        item = (room, place)
        if not self.nodes:
            self.nodes.append([item])
            self.tops.append(item)
            return
        i = min(bisect_left(self.tops, item), len(self.nodes) - 1)
        node = self.nodes[i]
        insort(node, item)
        self.tops[i] = node[-1]
        if len(node) > 2 * _NODE:
            self.nodes.insert(i + 1, node[_NODE:])
            del node[_NODE:]
            self.tops.insert(i, node[-1])

    def take_tightest(self, size):
        """Remove and return the bin with the least capacity that is enough for `size`."""
        wanted = (size, -1)
        i = bisect_left(self.tops, wanted)
        if i == len(self.nodes):
            return None
        node = self.nodes[i]
        item = node.pop(bisect_left(node, wanted))
        if node:
            self.tops[i] = node[-1]
        else:
            del self.nodes[i], self.tops[i]
        return item


def best_fit(sizes, capacity):
    """Bin number of each size, taken in the given order; a size above the capacity gets a bin alone."""
    tree, bins, placed = CapacityTree(), 0, []
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            room, place = capacity, bins
            bins += 1
        else:
            room, place = found
        placed.append(place)
        if room > size:
            tree.add(room - size, place)
    return placed, bins


def fewest_bytes(sizes, shards):
    """Shard of each size (descending), with the smallest capacity at which `shards` bins are enough."""
    if not sizes:
        return []
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if best_fit(sizes, middle)[1] <= shards:
            high = middle
        else:
            low = middle + 1
    return best_fit(sizes, high)[0]


def _pallets(capacity):
    def pack(batches):
        tree, bins = CapacityTree(), 0
        for batch in batches:
            placed = []
            for size in batch["bytes"].tolist():
                found = tree.take_tightest(size)
                if found is None:
                    room, place = capacity, bins
                    bins += 1
                else:
                    room, place = found
                placed.append(place)
                if room > size:
                    tree.add(room - size, place)
            yield pd.DataFrame({"group": batch["group"], "bytes": batch["bytes"], "lot": batch["lot"], "pallet": placed})

    return pack


def measured(docs):
    """doc_id, size, CRC-32 and the group (a digest of the text) of each document; no text leaves the scan."""
    data = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.length(data) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.unhex(F.md5(data)).alias("group"),
    )


def shard_groups(base, tables, shards=SHARDS, pallets_per_shard=PALLETS_PER_SHARD):
    """(group, shard) for all groups of `base`: large ones as a small table, the rest by join.

    Returns (large, small). `large` has at most shards * pallets_per_shard rows.
    """
    spark = base.sparkSession
    groups = tables.write(base.groupBy("group").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    capacity = max(1, total // (shards * pallets_per_shard))
    lots = shuffle_partitions(spark)
    small = (
        groups.filter(F.col("bytes") <= capacity)
        .withColumn("lot", F.pmod(F.xxhash64("group"), F.lit(lots)).cast("int"))
        .repartition(lots, "lot")
        .sortWithinPartitions(F.desc("bytes"), "group")
        .withColumn("lot", F.spark_partition_id())
        .mapInPandas(_pallets(capacity), "group binary, bytes bigint, lot int, pallet int")
    )
    small = tables.write(small, "pallets")
    # Fewer than shards * pallets_per_shard groups are larger than the capacity, and no two pallets
    # of a lot but one are less than half full, so the driver sees a few thousand rows at most.
    large_rows = groups.filter(F.col("bytes") > capacity).select("bytes", "group").collect()
    pallet_rows = small.groupBy("lot", "pallet").agg(F.sum("bytes").alias("bytes")).collect()
    items = [(row["bytes"], 0, bytes(row["group"])) for row in large_rows]
    items += [(row["bytes"], 1, (row["lot"], row["pallet"])) for row in pallet_rows]
    items.sort(key=lambda item: (-item[0], item[1], str(item[2])))
    shard_of = fewest_bytes([item[0] for item in items], shards)
    large = [(bytearray(item[2]), shard) for item, shard in zip(items, shard_of) if item[1] == 0]
    lots_of = [(*item[2], shard) for item, shard in zip(items, shard_of) if item[1] == 1]
    large = spark.createDataFrame(large, "group binary, shard int")
    placed = spark.createDataFrame(lots_of, "lot int, pallet int, shard int")
    small = small.join(F.broadcast(placed), ["lot", "pallet"]).select("group", "shard")
    return large, small


def with_slots(rows, tables):
    """Gapless slots from 0 inside each shard, numbered by many tasks.

    Rows are dealt out by hash; counts per (deal, shard), a few thousand, give each deal its start.
    """
    deals = shuffle_partitions(rows.sparkSession)
    spread = F.pmod(F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()), F.lit(deals)).cast("int")
    dealt = tables.write(rows.withColumn("_deal", spread), "dealt")
    counts = dealt.groupBy("shard", "_deal").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_deal", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_deal").orderBy("doc_id", "text_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(inside) - 1)
    return (
        ranked.join(F.broadcast(starts), ["shard", "_deal"])
        .withColumn("slot", (F.col("_start") + F.col("_rank")).cast("bigint"))
        .drop("_deal", "_start", "_rank")
    )


def shard_documents(docs, shards=SHARDS, pallets_per_shard=PALLETS_PER_SHARD):
    """Every document with its shard and slot; law `bytes`, so `grown_shard` is null.

    A document without text counts as empty (size 1). Repeated rows and equal texts share a shard.
    Documents with null doc_id are placed like others. Extra columns are ignored, an empty table
    gives an empty result. When one group is larger than an even share, its shard is the largest.
    """
    tables = run_tables(docs, "shards")
    base = tables.write(measured(docs), "measured")
    large, small = shard_groups(base, tables, shards, pallets_per_shard)
    marked = base.join(F.broadcast(large.withColumnRenamed("shard", "_large")), "group", "left")
    # Groups that are left hold at most one part in shards * pallets_per_shard of all bytes each.
    rest = marked.filter(F.col("_large").isNull()).drop("_large").join(small, "group")
    placed = marked.filter(F.col("_large").isNotNull()).withColumnRenamed("_large", "shard").unionByName(rest)
    return with_slots(placed.drop("group"), tables).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
