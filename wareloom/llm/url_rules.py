"""URL filters by a sort-merge range join of reversed hosts.

A host becomes a key of its labels in reverse, each closed by a dot: `www.example.com` is
`com.example.www.`. A rule's host and all its subdomains are then one interval of keys, the keys
that start with the rule's. Rule hosts and the distinct hosts of the URLs are sorted together and
swept once; the stack of open rules is an array with one place per depth, since of two open rules
one key always continues the other. URLs take the stack of their host and test its paths.
Everything is built from DataFrame functions.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wareloom.llm.common import run_tables, shuffle_partitions

# The rules of the contract.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DEFAULT_VERDICT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host_path(url):
    """(host, path) columns; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def host_key(host):
    """Labels in reverse order, each followed by a dot; an empty host has an empty key."""
    labels = F.transform(F.reverse(F.split(host, r"\.", -1)), lambda label: F.concat(label, F.lit(".")))
    return F.when(host == "", F.lit("")).otherwise(F.array_join(labels, ""))


def rules_table(spark, rules=RULES):
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, action string")


def rule_entries(rules):
    """One row per rule host: its key, depth and (path, rule, action) list, longest path first."""
    named = rules.filter(F.col("rule_host").isNotNull() & (F.col("rule_host") != "")).select(
        host_key(F.translate("rule_host", _UPPER, _LOWER)).alias("key"),
        F.coalesce("rule_path", F.lit("/")).alias("path"),
        F.concat("rule_host", F.coalesce("rule_path", F.lit("/"))).alias("rule"),
        "action",
    )
    grouped = named.groupBy("key").agg(
        F.sort_array(F.collect_set(F.struct(F.length("path").alias("n"), "path", "rule", "action")), asc=False).alias("entries")
    )
    return grouped.withColumn("depth", F.size(F.split("key", r"\.", -1)) - 1)


def sweep(hosts, rules, tables):
    """(key, stack) for each host key: the entries of all rule hosts above it, deepest first.

    Keys are range-partitioned and sorted; a window in each partition carries the last rule seen at
    each depth. A partition starts with the last rules of the partitions before it: one row per
    partition, whose number is fixed.
    """
    spark = hosts.sparkSession
    entries = tables.write(rule_entries(rules), "rules")
    deepest = entries.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    if deepest == 0:
        return None
    events = entries.select("key", F.lit(0).alias("kind"), "depth", "entries").unionByName(
        hosts.select("key", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("depth"),
                     F.lit(None).cast(entries.schema["entries"].dataType).alias("entries"))
    )
    parts = shuffle_partitions(spark)
    sorted_events = events.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id())
    sorted_events = tables.write(sorted_events, "events")

    def level(depth):
        return F.when(F.col("depth") == depth, F.struct("key", "entries"))

    levels = [f"level_{depth}" for depth in range(1, deepest + 1)]
    lasts = sorted_events.filter("kind = 0").groupBy("part").agg(
        *[F.max_by(level(d), F.when(F.col("depth") == d, F.col("key"))).alias(name) for d, name in enumerate(levels, 1)]
    )
    # One row per partition of the sweep meets in one task here.
    every = spark.range(parts).select(F.col("id").cast("int").alias("part")).join(lasts, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("part", *[F.last(name, True).over(before).alias(f"carried_{name}") for name in levels])
    in_part = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = sorted_events.select(
        "part", "key", "kind", *[F.last(level(d), True).over(in_part).alias(name) for d, name in enumerate(levels, 1)]
    )
    opened = swept.filter("kind = 1").join(F.broadcast(carried), "part")
    stack = F.array(*[F.coalesce(name, f"carried_{name}") for name in reversed(levels)])
    active = F.filter(stack, lambda rule: rule.isNotNull() & F.startswith(F.col("key"), rule["key"]))
    return opened.select("key", F.flatten(F.transform(active, lambda rule: rule["entries"])).alias("stack"))


def filter_urls(pages, rules, default=DEFAULT_VERDICT):
    """page_id, host, path, rule and verdict of each page; the rule with the longest host, then path, wins.

    A URL that is null or has no `://` has empty host and path, fits no rule and gets the default
    verdict; so does any URL no rule fits. Repeated rows are judged one by one. Rules without a
    host are ignored; no rules at all leave everything to the default. Extra columns are ignored.
    """
    tables = run_tables(pages, "url-rules")
    host, path = url_host_path(F.col("url").cast("string"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    hosts = parsed.select("key").distinct()
    stacks = sweep(hosts, rules, tables)
    if stacks is None:
        fitted = parsed.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"))
    else:
        # One row per host on the right: Spark broadcasts it if it is small and splits hot hosts if not.
        stacks = tables.write(stacks.filter(F.size("stack") > 0), "stacks")
        fits = F.filter("stack", lambda rule: F.startswith(F.col("path"), rule["path"]))
        fitted = parsed.join(stacks, "key", "left").withColumn("_hit", F.get(fits, F.lit(0))).select(
            "page_id", "host", "path", F.col("_hit.rule").alias("rule"), F.col("_hit.action").alias("action")
        )
    return fitted.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
