"""Captured responses and page lists."""

from pyspark.sql import functions as F

from wareloom.operators.ordering import with_positions
from wareloom.schemas import CAPTURES, PAGE_LIST
from wareloom.sources.page_lists import read_array


def read_captures(spark, path):
    """Captured responses stored as parquet, with the fixed capture schema."""
    return spark.read.schema(CAPTURES).parquet(path)


def read_page_list(spark, path=None, urls=(), json_lines=False):
    """Candidates (url, cand_ord): explicit URLs first, then those of a page-list export.

    Entries without `loc` are skipped and repeats are kept. An export holds one JSON array per file, or
    JSON lines; both are read in byte ranges. File order is by path.
    """
    explicit = spark.createDataFrame(list(zip(urls, range(len(urls)))), "url string, cand_ord bigint")
    if path is None:
        return explicit
    if json_lines:
        rows = spark.read.schema(PAGE_LIST).option("mode", "FAILFAST").json(path)
        order = ["file", "block", "row"]
        listed = rows.select(
            F.col("loc").alias("url"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
    else:
        order = ["file", "number"]
        listed = read_array(spark, path).select(F.col("page.loc").alias("url"), *order)
    placed = with_positions(listed.filter(F.col("url") != ""), order, "place")
    return explicit.unionByName(placed.select("url", (F.col("place") - 1 + F.lit(len(urls))).alias("cand_ord")))
