"""Crawl state on a shared file system: whole snapshots of parquet tables, bucketed by URL."""

import hashlib

from pyspark.sql import functions as F

from wareloom.functions.urls import host_of
from wareloom.operators.url_filter import url_filter
from wareloom.schemas import PAGES, SITEMAPS, STRUCTURED_PRODUCTS, column_names
from wareloom.session import folder_names, path_exists

_SCHEMAS = {"pages": PAGES, "sitemaps": SITEMAPS, "structured_products": STRUCTURED_PRODUCTS}

# Pages lie apart by whether they are pending, so that the frontier reads pending files only.
_LAYOUT = {"pages": ("pending", "visited_at IS NULL")}

# Buckets of a snapshot unless the caller names a number; some 200 MB a bucket are a good size.
BUCKETS = 8


def host_or_fail(host, url):
    """State is kept per host; a row without one has no place to go."""
    message = F.concat(F.lit("cannot derive a state location from URL "), F.coalesce(url, F.lit("NULL")))
    return F.when(F.coalesce(host, F.lit("")) == "", F.raise_error(message).cast("string")).otherwise(host)


class CrawlState:
    """Tables `pages`, `sitemaps` and `structured_products` under one root folder.

    Pages and sitemaps are whole snapshots, one folder for each change, <table>/<number>-<buckets>. The
    newest one that Spark has finished, which its _SUCCESS file tells, is the current one: readers see a
    change whole or not at all, and what a writer that died left behind is never read. Snapshots are
    Spark tables bucketed and sorted by URL, so merges join them bucket by bucket without moving the
    stored rows, and looking up a URL reads one bucket; Parquet Bloom filters then skip row groups.
    Products are partitioned by the run that found them. Older snapshots stay until the storage's own
    rules remove them. One writer at a time; the number of buckets may change from snapshot to snapshot.
    """

    @classmethod
    def for_url(cls, spark, root, url, buckets=BUCKETS):
        """A state of its own for the host of `url`, at <root>/<host>; no host is an error."""
        host = host_of(url)
        if not host:
            raise ValueError(f"cannot derive a state location from URL {url!r}")
        return cls(spark, f"{root.rstrip('/')}/{host}", buckets)

    def __init__(self, spark, root, buckets=BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets

    def _path(self, table, snapshot=None):
        return f"{self.root}/{table}" + (f"/{snapshot[0]:08d}-{snapshot[1]}" if snapshot else "")

    def _snapshots(self, table):
        """(number, buckets) of the snapshots, unfinished ones included, the newest first."""
        names = [name for name in folder_names(self.spark, self._path(table)) if name[:1].isdigit()]
        return sorted((tuple(map(int, name.split("-"))) for name in names), reverse=True)

    def _table_name(self, path):
        return f"wareloom_{hashlib.md5(path.encode()).hexdigest()}"

    def _bucketed(self, path, table, buckets):
        """The snapshot as a table of this session's catalog, which is how Spark learns of its buckets."""
        name = self._table_name(path)
        if not self.spark.catalog.tableExists(name):
            location = path.replace("\\", "\\\\").replace("'", "\\'")
            apart = table in _LAYOUT
            self.spark.sql(
                f"CREATE TABLE {name} ({_SCHEMAS[table]}{f', {_LAYOUT[table][0]} boolean' if apart else ''}) USING parquet "
                f"{f'PARTITIONED BY ({_LAYOUT[table][0]}) ' if apart else ''}"
                f"CLUSTERED BY (url) SORTED BY (url) INTO {buckets} BUCKETS LOCATION '{location}'"
            )
            if apart:
                self.spark.sql(f"MSCK REPAIR TABLE {name}")
        return self.spark.table(name)

    def _newest(self, table):
        """(number, buckets) of the newest finished snapshot, or None."""
        done = (s for s in self._snapshots(table) if path_exists(self.spark, f"{self._path(table, s)}/_SUCCESS"))
        return next(done, None)

    def _current(self, table):
        """The newest finished snapshot with the column it is laid out by, or None."""
        snapshot = self._newest(table)
        return self._bucketed(self._path(table, snapshot), table, snapshot[1]) if snapshot else None

    def read_pending(self):
        """The stored pages that have not been visited; files of other pages are not read."""
        pages = self._current("pages")
        if pages is None:
            return self.read("pages")
        return pages.filter(F.col(_LAYOUT["pages"][0])).select(*column_names(PAGES))

    def read(self, table):
        """The current rows of a table."""
        if table == "structured_products":
            if not path_exists(self.spark, self._path(table)):
                return self.spark.createDataFrame([], STRUCTURED_PRODUCTS)
            return self.spark.read.schema(STRUCTURED_PRODUCTS).parquet(self._path(table)).select(*column_names(STRUCTURED_PRODUCTS))
        rows = self._current(table)
        return self.spark.createDataFrame([], _SCHEMAS[table]) if rows is None else rows.select(*column_names(_SCHEMAS[table]))

    def replace(self, table, rows):
        """Make `rows` the current rows of a table; they may be made from the ones before."""
        number = max((n for n, _ in self._snapshots(table)), default=0) + 1
        path = self._path(table, (number, self.buckets))
        placed = rows.withColumn("host", host_or_fail(F.col("host"), F.col("url"))).select(*column_names(_SCHEMAS[table]))
        if table in _LAYOUT:
            placed = placed.withColumn(_LAYOUT[table][0], F.expr(_LAYOUT[table][1]))
        writer = placed.write.format("parquet").bucketBy(self.buckets, "url").sortBy("url")
        writer = writer.partitionBy(_LAYOUT[table][0]) if table in _LAYOUT else writer
        writer = writer.option("parquet.bloom.filter.enabled#url", "true").option("path", path)
        writer.saveAsTable(self._table_name(path))

    def url_filter(self, table):
        """The Bloom filter of the current URLs of a table, made by its first reader and kept beside the snapshots."""
        snapshot = self._newest(table)
        if snapshot is None:
            return url_filter(self.read(table))
        path = f"{self.root}/_url_filters/{table}/{snapshot[0]:08d}"
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            url_filter(self.read(table)).coalesce(1).write.mode("overwrite").parquet(path)
        return self.spark.read.schema("bitmap_id bigint, bitmap binary").parquet(path)

    def next_run(self):
        """An id no stored run has; a run that is repeated under its id replaces its products."""
        return self.read("structured_products").agg(F.coalesce(F.max("batch_id"), F.lit(0)) + 1).first()[0]

    def append_products(self, products):
        """Append products; writing a batch again replaces that batch instead of doubling it."""
        placed = products.withColumn("host", host_or_fail(F.col("host"), F.col("url")))
        (
            placed.hint("rebalance", "host")
            .sortWithinPartitions("batch_id", "host", "url")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(self._path("structured_products"))
        )


def write_state(df, path):
    """Write one host-partitioned state table to `path`."""
    placed = df.withColumn("host", host_or_fail(F.col("host"), F.col("url")))
    sorted_rows = placed.hint("rebalance", "host").sortWithinPartitions("host", "url")
    sorted_rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#url", "true").partitionBy("host").parquet(path)


def read_state(spark, path, schema, host=None):
    """Read a host-partitioned state table, pruned to one host when given."""
    rows = spark.read.schema(schema).parquet(path)
    return rows if host is None else rows.filter(F.col("host") == host)
