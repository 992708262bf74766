"""Closure of sitemap indexes from a set of start URLs, from scratch or from a stored closure and what changed."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareloom.fixed_values import FAILED, INDEX_ROOT, ROBOTS_SOURCE, SET_ROOT
from wareloom.operators.joins import latest_rows
from wareloom.operators.sitemaps import parse_sitemaps
from wareloom.session import RunTables

NOT_CAPTURED = "not captured"
ORDER = ("batch_id", "seq")

VISITED = "url string, discovered_from string, trail array<bigint>, depth int"
CLOSURE_SCHEMAS = {
    "starts": "url string, ord bigint",
    "docs": (
        "url string, status string, type string, error string, delay_ms bigint, duration_ms bigint, batch_id bigint, seq bigint, "
        "children array<string>, entries array<struct<loc:string,lastmod:string>>"
    ),
    "links": "parent string, children array<string>",
    "visited": VISITED,
}


class Closure(NamedTuple):
    """A resolved closure; every table but `starts` has one row per URL.

    `docs` are the latest parsed documents, `links` the index documents among them with their children,
    and `visited` has each reached URL with its place: depth, the positions on its path, and the parent.
    """

    starts: DataFrame
    docs: DataFrame
    links: DataFrame
    visited: DataFrame


def store_closure(closure, path):
    """Write a closure as whole tables into a folder of its own."""
    for name, rows in closure._asdict().items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def read_closure(spark, path):
    return Closure(**{name: spark.read.schema(ddl).parquet(f"{path}/{name}") for name, ddl in CLOSURE_SCHEMAS.items()})


def latest_documents(captures, tables, name="docs"):
    """Parsed documents, of several captures of a URL the latest by (batch_id, seq)."""
    return latest_rows(tables.write(parse_sitemaps(captures), name), "url", tables, name, ORDER)


def _links(docs):
    return docs.filter(F.col("type") == INDEX_ROOT).select(F.col("url").alias("parent"), "children")


def _roots(starts):
    return starts.groupBy("url").agg(F.min(F.col("ord").cast("bigint")).alias("ord"))


def _entries(links):
    """Edges (parent, child, entry_ord) with repeats; the positions are those in the document."""
    listed = links.select("parent", F.posexplode_outer("children").alias("entry_ord", "child"))
    return listed.filter(F.col("child") != "").select("parent", "child", F.col("entry_ord").cast("bigint"))


def _edges(links):
    """Edges with the first position of each child of a parent."""
    return _entries(links).groupBy("parent", "child").agg(F.min("entry_ord").alias("entry_ord"))


def _step(reached, edges):
    """Places of the children of `reached`, by the parent's place and the child's position."""
    return reached.join(edges, reached.url == edges.parent).select(
        F.col("child").alias("url"),
        F.col("parent").alias("discovered_from"),
        F.concat("trail", F.array("entry_ord")).alias("trail"),
        (F.col("depth") + 1).alias("depth"),
    )


def _best(places):
    """The least place of each URL by (depth, path)."""
    least = places.groupBy("url").agg(F.min(F.struct("depth", "trail", "discovered_from")).alias("least"))
    return least.select("url", "least.discovered_from", "least.trail", "least.depth")


def _root_places(roots):
    return roots.select(
        "url", F.lit(ROBOTS_SOURCE).alias("discovered_from"), F.array("ord").alias("trail"), F.lit(0).alias("depth")
    )


def resolve_closure(captures, starts, tables=None):
    """The closure of the index links from `starts` (url, ord) over captured documents.

    Each URL string is visited once, so cycles end. Documents are parsed, and their links written, once,
    before the hops: a hop only joins the frontier with the links of index documents, one row per
    document on either side, so no key can be hot, and no hop aggregates documents. When several parents
    name a child, the least (depth, parent order, entry position) owns it.
    """
    spark = captures.sparkSession
    tables = tables or RunTables(spark, "resolve")
    docs = latest_documents(captures, tables)
    links = tables.write(_links(docs), "links")
    roots = tables.write(_roots(starts), "starts")
    visited_path = tables.path("visited")
    frontier = _root_places(roots)
    columns = VISITED.removesuffix(", depth int")
    depth = 0
    while True:
        hop_path = f"{visited_path}/depth={depth}"
        frontier.drop("depth").write.mode("overwrite").parquet(hop_path)
        hop = spark.read.schema(columns).parquet(hop_path).withColumn("depth", F.lit(depth))
        visited = spark.read.schema(VISITED).parquet(visited_path)
        if hop.isEmpty():
            return Closure(roots, docs, links, visited)
        frontier = _best(_step(hop, _entries(links))).join(visited.select("url"), "url", "left_anti")
        depth += 1


def update_closure(before, captures, starts=None, withdrawn=None, tables=None):
    """A stored closure brought up to date with new `captures`; returns (closure, changed URLs).

    `starts` are all start URLs if they have changed. URLs in `withdrawn` count as no longer captured.
    A capture older than the stored document changes nothing.

    Only edges of arriving documents are compared with the stored ones. Places that hang on an edge that
    is gone, or has another position, are given up together with all below them; then the places that
    new edges offer, and those the remaining documents offer to what was given up, are settled depth by
    depth, each going on to its children if it beats the place a URL has. The rest of the closure is
    read for joins with these few rows, and stays as it is.
    """
    spark = captures.sparkSession
    tables = tables or RunTables(spark, "update")
    fresh = latest_documents(captures, tables, "arrived")
    stored = before.docs.select("url", F.struct(*ORDER).alias("_stored"))
    newer = fresh.select("url", F.struct(*ORDER).alias("_own")).join(stored, "url", "left")
    newer = newer.filter(F.col("_stored").isNull() | (F.col("_own") >= F.col("_stored")))
    touched = newer.select("url")
    if withdrawn is not None:
        touched = touched.unionByName(withdrawn.select("url").join(fresh.select("url"), "url", "left_anti"))
    touched = tables.write(touched.distinct(), "touched")
    fresh = fresh.join(touched, "url", "left_semi")
    docs = before.docs.join(touched, "url", "left_anti").unionByName(fresh)
    parents = touched.select(F.col("url").alias("parent"))
    links = before.links.join(parents, "parent", "left_anti").unionByName(_links(fresh))

    roots = before.starts if starts is None else tables.write(_roots(starts), "starts")
    whole_edge = ["parent", "child", "entry_ord"]
    old_edges, new_edges = _edges(before.links.join(parents, "parent", "left_semi")), _edges(_links(fresh))
    removed = tables.write(old_edges.join(new_edges, whole_edge, "left_anti"), "removed")
    added = tables.write(new_edges.join(old_edges, whole_edge, "left_anti"), "added")

    deleted = _given_up(before, removed, roots, tables)
    kept = before.visited.join(deleted, "url", "left_anti")
    orphaned = _entries(links).join(deleted.withColumnRenamed("url", "child"), "child", "left_semi")
    offers = _step(kept, orphaned).unionByName(_step(kept, added))
    offers = offers.unionByName(_root_places(roots.join(before.starts, ["url", "ord"], "left_anti")))
    settled = _settled(tables.write(_best(offers), "offers"), kept, links, tables)

    visited = kept.join(settled.select("url"), "url", "left_anti").unionByName(settled)
    changed = touched.unionByName(deleted).unionByName(settled.select("url")).distinct()
    return Closure(roots, docs, links, visited), tables.write(changed, "changed")


def _given_up(before, removed, roots, tables):
    """URLs whose place hangs on a removed edge or start, with everything below them, hop by hop."""
    spark = removed.sparkSession
    below = before.visited.filter(F.col("depth") > 0).select("url", F.col("discovered_from").alias("parent"))
    lost = before.starts.join(roots, ["url", "ord"], "left_anti").select("url")
    hop = below.join(removed.select("parent", F.col("child").alias("url")), ["parent", "url"], "left_semi").select("url")
    hop = hop.unionByName(before.visited.filter("depth = 0").select("url").join(lost, "url", "left_semi"))
    path, number = tables.path("given-up"), 0
    while True:
        hop.write.mode("overwrite").parquet(f"{path}/hop={number}")
        last = spark.read.schema("url string").parquet(f"{path}/hop={number}")
        if last.isEmpty():
            return spark.read.schema("url string, hop int").parquet(path).select("url")
        hop = below.join(last.withColumnRenamed("url", "parent"), "parent", "left_semi").select("url")
        number += 1


def _settled(offers, kept, links, tables):
    """Places of `offers`, and of what is reached from them, that beat the places of `kept`, by depth.

    All offers of a depth come from the depth before, which is settled by then, so a place is final
    when it is taken.
    """
    spark = offers.sparkSession
    path = tables.path("settled")
    columns = VISITED.removesuffix(", depth int")
    # Distinct depths of nested indexes, a handful of numbers.
    waiting = sorted(row.depth for row in offers.select("depth").distinct().collect())
    settled = spark.createDataFrame([], VISITED)
    stood = kept.select("url", F.struct("depth", "trail").alias("_stood"))
    reached = None
    depth = waiting[0] if waiting else None
    while depth is not None:
        places = offers.filter(F.col("depth") == depth)
        if reached is not None:
            places = _best(places.unionByName(_step(reached, _entries(links))))
        places = places.join(settled.select("url"), "url", "left_anti").join(stood, "url", "left")
        better = places.filter(F.col("_stood").isNull() | (F.struct("depth", "trail") < F.col("_stood")))
        better.select("url", "discovered_from", "trail").write.mode("overwrite").parquet(f"{path}/depth={depth}")
        settled = spark.read.schema(VISITED).parquet(path)
        reached = spark.read.schema(columns).parquet(f"{path}/depth={depth}").withColumn("depth", F.lit(depth))
        if not reached.isEmpty():
            depth += 1
            continue
        reached = None
        depth = next((later for later in waiting if later > depth), None)
    return settled


def closure_records(closure, batch_id=0, only=None):
    """One record per visited URL, or per URL of `only`; a URL without capture is a failed record."""
    visited = closure.visited if only is None else closure.visited.join(only, "url", "left_semi")
    reached = visited.join(closure.docs.drop("batch_id", "seq").withColumn("captured", F.lit(True)), "url", "left")
    return reached.select(
        F.col("url").alias("loc"),
        "discovered_from",
        F.coalesce("status", F.lit(FAILED)).alias("status"),
        "type",
        F.when(F.col("captured").isNull(), F.lit(NOT_CAPTURED)).otherwise(F.col("error")).alias("error"),
        F.coalesce("delay_ms", F.lit(0).cast("bigint")).alias("delay_ms"),
        F.coalesce("duration_ms", F.lit(0).cast("bigint")).alias("duration_ms"),
        "depth",
        F.lit(batch_id).cast("bigint").alias("batch_id"),
        _place().alias("seq"),
    )


def _place():
    return F.concat(F.array(F.col("depth").cast("bigint")), F.col("trail"))


def closure_pages(closure, batch_id=0, only=None):
    """Page URLs of the visited URL sets, or of those in `only`."""
    visited = closure.visited if only is None else closure.visited.join(only, "url", "left_semi")
    entries = closure.docs.filter(F.col("type") == SET_ROOT).select("url", "entries")
    return (
        visited.join(entries, "url")
        .select("url", _place().alias("place"), F.posexplode("entries").alias("entry_ord", "entry"))
        .filter(F.col("entry.loc") != "")
        .select(
            "entry.loc",
            F.nullif(F.col("entry.lastmod"), F.lit("")).alias("lastmod"),
            F.col("url").alias("source_sitemap"),
            F.lit(batch_id).cast("bigint").alias("batch_id"),
            F.concat("place", F.array(F.col("entry_ord").cast("bigint"))).alias("seq"),
        )
    )


def resolve_sitemaps(captures, starts, batch_id=0, tables=None):
    """Sitemap records and page URLs reachable from `starts` (url, ord); see `resolve_closure`."""
    closure = resolve_closure(captures, starts, tables)
    return closure_records(closure, batch_id), closure_pages(closure, batch_id)
