"""Positions and slices in a global order without a one-task sort."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wareloom.session import RunTables

# Above this many rows a slice is cut by position instead of by a top-k heap.
TOP_K_ROWS = 100_000

_SLOT_BITS = 33


def with_positions(df, order, name="position", total=None, tables=None):
    """Add the 1-based position of each row in `order`, and optionally the row count.

    Rows are range-partitioned once and numbered inside their partition; partition
    sizes then give each partition its start. Only the sizes, one row per partition,
    meet in one task. The numbered rows are written first, since partition numbers
    must not change between counting and use. Pass narrow rows; `order` has to be
    free of ties for positions to be reproducible.
    """
    tables = tables or RunTables(df.sparkSession, "positions")
    numbered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_slot", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _SLOT_BITS) - 1)))
    )
    rows = tables.write(numbered, f"numbered-{name}")
    by_part = Window.orderBy("_part")
    starts = (
        rows.groupBy("_part")
        .agg(F.count("*").alias("_size"))
        .select(
            "_part",
            (F.sum("_size").over(by_part) - F.col("_size")).alias("_before"),
            F.sum("_size").over(Window.partitionBy()).alias("_total"),
        )
    )
    # One row per partition of the range shuffle, so the broadcast has a known bound.
    placed = rows.join(F.broadcast(starts), "_part")
    extra = [F.col("_total").alias(total)] if total else []
    return placed.select(*df.columns, (F.col("_before") + F.col("_slot") + 1).alias(name), *extra)


def slice_ordered(df, order, skip=0, limit=0):
    """Rows `skip` to `skip + limit` of `df` in `order`; limit 0 means all that follow.

    Small slices are a top-k; a slice without limit or a very large one is cut by
    position, since Spark would send it through a single task otherwise.
    """
    if limit > 0 and skip + limit <= TOP_K_ROWS:
        ordered = df.orderBy(*order)
        return (ordered.offset(skip) if skip else ordered).limit(limit)
    if limit <= 0 and skip <= 0:
        return df.orderBy(*order)
    placed = with_positions(df, order, "_position")
    kept = placed.filter(F.col("_position") > skip)
    if limit > 0:
        kept = kept.filter(F.col("_position") <= skip + limit)
    return kept.orderBy("_position").drop("_position")
