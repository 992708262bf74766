"""Spelling variants: words at one edit from each other, found through pairs of trie nodes.

A word of the dictionary is a path in the trie of all words and one in the trie of all reversed words.
Leaving out its letter at place i leaves the pair (node before the letter, reversed node after it); no
letter between them, the pair (node at i, reversed node at i) stands for the word itself. Two words at
one replaced letter have the first kind of pair in common, a word and one with a letter more have a
pair of the first kind and one of the second. Nodes are numbered, so a pair is two integers and equal
pairs are exact neighbours. A node that only one word passes cannot be in a common pair and gets no number.
"""

import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import functions as F

from wareloom.llm.common import run_tables
from wareloom.operators.ordering import with_positions

LEAST_LENGTH = 7
LEAST_N = 2
FORM_TIMES = 10
DROP_ONE_IN = 31

_RUN = re.compile(rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

# Distinct words a task counts before it hands them on; bounds its memory.
COUNTED = 200_000
# Numbers of nodes are (partition, number in it).
_PART_BITS = 40
# A member of a group is the rank of its word with two flags.
SPLIT, CANON = 2, 1


def words_with_errors(doc_id, text):
    """Counts of the words of one whole text, each run losing a letter where its hash says so."""
    counts = Counter()
    lowered = text.encode("utf-8", "surrogatepass").translate(_LOWERED).decode("utf-8", "surrogatepass")
    for run, n in Counter(_RUN.findall(lowered)).items():
        h = crc32(f"{doc_id}:{run}".encode("utf-8", "surrogatepass"))
        if h % DROP_ONE_IN == 0:
            place = h % len(run)
            run = run[:place] + run[place + 1 :]
        if len(run) >= LEAST_LENGTH:
            counts[run] += n
    return counts


def _count_batches(batches):
    counts = Counter()

    def counted():
        table = pa.record_batch({"word": pa.array(list(counts), pa.string()), "n": pa.array(counts.values(), pa.int64())})
        counts.clear()
        return table

    for batch in batches:
        for doc_id, text in zip(*(column.to_pylist() for column in batch.columns)):
            if text:
                counts.update(words_with_errors(doc_id, text))
            if len(counts) >= COUNTED:
                yield counted()
    yield counted()


def dictionary(docs):
    """Words of all whole texts (word, n) with at least LEAST_N occurrences."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text").cast("string"))
    counts = rows.mapInArrow(_count_batches, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_N)


def common_prefix(a, b):
    """Number of code points two strings begin with together."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    for i in range(n):
        if a[i] != b[i]:
            return i


def spine(bounds):
    """Paths that neighbouring partitions share: {part: (text shared with the one before, its nodes)}.

    `bounds` is (part, first, last) of each partition of the sorted keys. A node in two partitions is a
    prefix of the shared text of all boundaries between them, so numbering these texts in order, each
    from where it leaves the one before, gives such a node one number. The numbers are negative.
    """
    shared, path, nodes, last, n = {}, "", [], None, 0
    for part, first, end in sorted(bounds):
        if last is not None:
            text = first[: common_prefix(first, last)]
            kept = common_prefix(text, path)
            nodes = nodes[:kept] + [-(n + i + 1) for i in range(len(text) - kept)]
            n += len(text) - kept
            path = text
            shared[part] = (path, nodes)
        last = end
    return shared


def numbered_path(keys, part, before, after):
    """Nodes of the sorted `keys` of one partition, from the root (0) as far as another key passes them.

    `before` and `after` are (text, nodes) shared with the partitions on either side.
    """
    previous, stack = before[0], [0, *before[1]]
    number = 0
    shared = len(before[0])
    key = next(keys, None)
    while key is not None:
        following = next(keys, None)
        ahead = common_prefix(key, after[0] if following is None else following)
        depth = max(shared, ahead)
        beyond = common_prefix(key, after[0])
        del stack[shared + 1 :]
        for d in range(shared + 1, depth + 1):
            if d <= beyond:
                stack.append(after[1][d - 1])
            else:
                number += 1
                stack.append((part << _PART_BITS) | number)
        yield list(stack)
        key, shared = following, ahead


def _number(shared, following):
    """Numbers paths of partitions that come sorted by (part, key), one after the other."""

    def rows(batches):
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns))

    def numbered(batches):
        stream = rows(batches)
        row = next(stream, None)
        while row is not None:
            part, ranks, ahead = row[0], [], [None]

            def keys():
                current = row
                while current is not None and current[0] == part:
                    ranks.append(current[2])
                    yield current[1]
                    current = next(stream, None)
                ahead[0] = current

            none = ("", [])
            paths = []
            for path in numbered_path(keys(), part, shared.get(part, none), shared.get(following.get(part), none)):
                paths.append(path)
                if len(paths) == 10_000:
                    done, ranks[:] = ranks[: len(paths)], ranks[len(paths) :]
                    yield pa.record_batch({"rank": pa.array(done, pa.int64()), "nodes": pa.array(paths, pa.list_(pa.int64()))})
                    paths = []
            yield pa.record_batch({"rank": pa.array(ranks, pa.int64()), "nodes": pa.array(paths, pa.list_(pa.int64()))})
            row = ahead[0]

    return numbered


def trie_nodes(words, key, name, tables):
    """Rows (rank, <name>): numbers of the trie nodes on the path of each distinct `key`, the root first.

    Keys are range-partitioned and swept in order. Like the range partitioner itself, the driver sees two
    keys per partition, to number the nodes that lie across a boundary.
    """
    placed = words.select(key.alias("key"), "rank").repartitionByRange("key")
    placed = tables.write(placed.withColumn("part", F.spark_partition_id()), f"sorted-{name}")
    bounds = [tuple(row) for row in placed.groupBy("part").agg(F.min("key"), F.max("key")).collect()]
    parts = sorted(part for part, *_ in bounds)
    sweep = _number(spine(bounds), dict(zip(parts, parts[1:])))
    swept = placed.select("part", "key", "rank").repartition("part").sortWithinPartitions("part", "key")
    return swept.mapInArrow(sweep, "rank bigint, nodes array<bigint>").withColumnRenamed("nodes", name)


def node_pairs(words, tables):
    """Rows (before, after, member): the pairs of each word whose two nodes other words pass as well."""
    forward = trie_nodes(words, F.col("word"), "before", tables)
    reverse = trie_nodes(words, F.reverse("word"), "after", tables)
    paths = words.select("rank", "word").join(forward, "rank").join(reverse, "rank")
    paths = tables.write(paths.withColumn("length", F.length("word")), "paths")

    def pairs(left_out):
        """Pairs of nodes between which `left_out` letters lie, for all places where both are numbered."""
        first = F.greatest(F.lit(0), F.col("length") - left_out - (F.size("after") - 1))
        last = F.least(F.size("before") - 1, F.col("length") - left_out)
        places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        placed = paths.withColumn("place", F.explode(places))
        # Of equal letters in a row only the first is left out of the longer word, so that a pair of words meets once.
        letter = F.substring("word", F.col("place") + 1, F.lit(1))
        canon = (F.col("place") == 0) | (letter != F.substring("word", F.col("place"), F.lit(1)))
        flags = F.when(canon, F.lit(CANON)).otherwise(F.lit(0)) if left_out else F.lit(SPLIT + CANON)
        return placed.select(
            F.get("before", F.col("place")).alias("before"),
            F.get("after", F.col("length") - left_out - F.col("place")).alias("after"),
            (F.col("rank") * 4 + flags).alias("member"),
        )

    return pairs(1).unionByName(pairs(0))


def neighbours(words, tables):
    """Rows (rank, n_near, best): number of near words and the lowest rank among them, where there is one.

    A group has at most one word per letter of the alphabet and one without it, 91 in all, so its list is
    bounded; each member leaves it as one row, not one per neighbour.
    """
    groups = node_pairs(words, tables).groupBy("before", "after").agg(F.sort_array(F.collect_list("member")).alias("group"))
    members = groups.filter(F.size("group") > 1).select("group", F.explode("group").alias("member"))
    own = F.col("member")
    near = F.filter(
        "group",
        lambda other: (other != own)
        & (
            ((other.bitwiseAND(F.lit(SPLIT)) == 0) & (own.bitwiseAND(F.lit(SPLIT)) == 0))
            | ((other.bitwiseAND(F.lit(CANON)) == CANON) & (own.bitwiseAND(F.lit(CANON)) == CANON))
        ),
    )
    found = members.select(F.shiftright("member", 2).alias("rank"), near.alias("near")).filter(F.size("near") > 0)
    return found.groupBy("rank").agg(
        F.sum(F.size("near")).cast("bigint").alias("n_near"), F.min(F.shiftright(F.get("near", F.lit(0)), 2)).alias("best")
    )


def roots(forms, tables):
    """Rows (rank, root): where following forms (rank, form) ends; each round doubles the steps taken.

    A form occurs FORM_TIMES as often as its word, so chains are short and have no cycles.
    """
    reached = forms.select("rank", F.col("form").alias("root"))
    step = 0
    while True:
        step += 1
        further = reached.select(F.col("rank").alias("root"), F.col("root").alias("_next"))
        joined = tables.write(reached.join(further, "root", "left"), f"roots-{step}")
        if joined.filter(F.col("_next").isNotNull()).isEmpty():
            return reached
        reached = joined.select("rank", F.coalesce("_next", "root").alias("root"))


def spelling_variants(docs):
    """word, form, root, n, n_near and form_n for every word of at least 7 letters that occurs twice.

    Words come from whole texts, a letter left out where the hash of id and run says so; a missing id
    counts as empty, a missing or empty text has no words, repeated rows count each. Form and root are
    those of the contract: the near word of largest n, the first in code-point order among equals, if it
    occurs ten times as often. Extra columns are ignored; an empty table gives an empty result.
    """
    tables = run_tables(docs, "spelling")
    counted = tables.write(dictionary(docs), "dictionary")
    # Ranks go by falling n, then code points: the lowest rank of some words is the best of them.
    words = tables.write(with_positions(counted, [F.desc("n"), F.col("word")], "rank", tables=tables), "words")
    near = tables.write(neighbours(words, tables), "near")
    best = words.select(F.col("rank").alias("best"), F.col("word").alias("_form"), F.col("n").alias("_form_n"))
    linked = words.join(near.join(best, "best"), "rank", "left")
    grown = F.col("_form_n") >= FORM_TIMES * F.col("n")
    linked = tables.write(
        linked.select(
            "rank", "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(grown, F.col("best")).alias("form_rank"),
            F.when(grown, F.col("_form")).alias("form"),
            F.when(grown, F.col("_form_n")).alias("form_n"),
        ),
        "linked",
    )
    last = roots(linked.filter(F.col("form_rank").isNotNull()).select("rank", F.col("form_rank").alias("form")), tables)
    named = last.join(words.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root").select("rank", "root_word")
    return linked.join(named, "rank", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )
