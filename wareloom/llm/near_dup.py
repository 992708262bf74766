"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

1. Every document gets its 3-word shingles, a digest of its words and a SuperMinHash signature cut
   into bands. Documents with equal words form one class; a class goes on as its smallest id.
2. Classes that share a band form a bucket. The bucket's smallest class is its pivot, and all others
   are verified against the pivot on full sets: as many rows as members, never all pairs.
3. Members that are no match for the pivot may still match each other. A pivot's members that fall into
   several components get a centre: the member nearest to the shingles most of them have. Let D(x) be
   the shingles in which x and the centre differ. x and y differ in D(x) ^ D(y); if they match and x
   does not match the centre, D(x) and D(y) overlap, and by so much that x and y share an element
   among the first few of D(x) and D(y) in any fixed order (prefix filter). The order puts what a member
   has of its own first, so only members with the same rare changes meet. Every pair that shares a
   band is thereby connected or refuted exactly, without a look at most of them.
4. Links are thinned by union-find inside each task and then contracted, smallest id first, until
   no link is left between components.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wareloom.llm.common import run_tables
from wareloom.llm.shingles import mix, normalised, shingle_hashes, signed

WORDS = 3
# Links: 100 * intersection >= 85 * union.
PERCENT = 85
# A pair at the threshold misses all bands with probability (1 - 0.85 ** ROWS) ** BANDS = 1.8e-6.
BANDS, ROWS = 28, 6
EDGES_AT_ONCE = 200_000

SKETCH = "doc_id bigint, digest binary, n_shingles bigint, bands array<bigint>"
_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def super_minhash(elements, m):
    """SuperMinHash signature of a set of 64-bit hashes.

    Each element draws a random permutation of the m places step by step, and at step j offers
    j + r with r in [0, 1) to its j-th place; a place keeps the least offer. All elements take step
    j together. Once every place holds an offer from steps up to j, later offers cannot win, and the
    rest of the permutations is never drawn. Values are fixed-point numbers, step in the upper half.
    """
    signature = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    n = len(elements)
    if not n:
        return signature
    rows = np.arange(n)
    places = None
    with np.errstate(over="ignore"):
        for step in range(m):
            draw = mix(elements + _GAMMA * np.uint64(step + 1))
            offers = (np.uint64(step) << np.uint64(32)) | (draw >> np.uint64(32))
            pick = step + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m - step) >> np.uint64(32)).astype(np.int64)
            if step == 0:
                chosen = pick
            else:
                if places is None:
                    places = np.tile(np.arange(m, dtype=np.int16), (n, 1))
                    places[rows, first] = 0
                    places[:, 0] = first
                chosen = places[rows, pick].astype(np.int64)
                places[rows, pick] = places[:, step]
            np.minimum.at(signature, chosen, offers)
            if step == 0:
                first = pick
            if signature.max() < np.uint64(step + 1) << np.uint64(32):
                break
    return signature


def band_keys(signature, bands=BANDS, rows=ROWS):
    """One 64-bit key per band, different bands apart."""
    table = signature[: bands * rows].reshape(bands, rows)
    keys = mix(np.arange(bands, dtype=np.uint64))
    for column in range(rows):
        keys = mix(keys ^ table[:, column])
    return keys


def _sketch(words, bands, rows):
    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                data = normalised(text)
                elements = np.unique(shingle_hashes(data, words))
                keys = signed(band_keys(super_minhash(elements, bands * rows), bands, rows)) if len(elements) else []
                digest = hashlib.blake2b(data, digest_size=16).digest()
                out.append((doc_id, digest, len(elements), keys))
            yield pd.DataFrame(out, columns=["doc_id", "digest", "n_shingles", "bands"]).astype({"doc_id": "Int64"})

    return run


def _sets(words):
    def run(batches):
        for batch in batches:
            sets = [signed(np.unique(shingle_hashes(normalised(text), words))) for text in batch["text"]]
            yield pd.DataFrame({"node": batch["doc_id"], "shingles": sets})

    return run


def _plain(docs):
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def band_pairs(sketches, tables):
    """(node, pivot): every class next to the smallest class of each of its buckets."""
    named = sketches.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    nodes = named.groupBy("digest").agg(F.min("doc_id").alias("node")).select("node").distinct()
    heads = named.select(F.col("doc_id").alias("node"), "bands").join(tables.write(nodes, "nodes"), "node", "left_semi")
    members = heads.select("node", F.explode("bands").alias("band"))
    several = members.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("_high"))
    several = tables.write(several.filter("pivot < _high").drop("_high"), "buckets")
    found = members.join(several, "band").filter("node != pivot").select("node", "pivot").distinct()
    return tables.write(found, "pairs")


def verified(pairs, sets, percent):
    """The pairs (node, pivot) whose full sets match."""
    own = sets.select("node", F.col("shingles").alias("own"))
    other = sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("theirs"))
    common = F.size(F.array_intersect("own", "theirs"))
    sized = pairs.join(own, "node").join(other, "pivot").select(
        "node", "pivot", common.alias("common"), (F.size("own") + F.size("theirs")).alias("both")
    )
    return sized.filter(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("both") - F.col("common"))).select("node", "pivot")


def _count_elements(batches):
    for batch in batches:
        parts = []
        for group, rows in batch.groupby("group"):
            elements, counts = np.unique(np.concatenate(rows["own"].to_list()), return_counts=True)
            parts.append(pd.DataFrame({"group": group, "element": elements, "n": counts}))
        if parts:
            yield pd.concat(parts)


def centres(members, tables):
    """(group, centre, usual): the shingles more than half of a group's members have, and the nearest member."""
    sizes = members.groupBy("group").agg(F.count("*").alias("members"))
    counted = members.mapInPandas(_count_elements, "group bigint, element bigint, n bigint")
    usual = (
        counted.groupBy("group", "element")
        .agg(F.sum("n").alias("n"))
        .join(sizes, "group")
        .filter(F.col("n") * 2 > F.col("members"))
        # No more than twice the shingles of a member.
        .groupBy("group")
        .agg(F.sort_array(F.collect_list("element")).alias("usual"))
    )
    usual = tables.write(usual, "usual")
    shared = F.size(F.array_intersect("own", "usual"))
    apart = (F.size("own") + F.size("usual") - 2 * shared).alias("apart")
    near = members.join(usual, "group").select("group", "node", apart)
    nearest = near.groupBy("group").agg(F.min_by("node", F.struct("apart", "node")).alias("centre"))
    return tables.write(nearest.join(usual, "group"), "centres")


def differences(members, centre_of, sets, percent):
    """(group, element, node, place, apart, n, near, loose): the first elements of each member's difference.

    With c = (100 - percent) / (100 + percent), sets x and y match if |D(x) ^ D(y)| <= c (|x| + |y|).
    If z matches some y, they share at least |D(z)| - c |z| (1 + 100 / percent) elements of D(z). If
    moreover y is no match for the centre p, they share more than (|D(z)| + c (|p| - |z|)) / 2. The first
    bound gives the prefix by which z meets any partner, both give the shorter one (`near`) by which it
    meets partners that are no match for the centre (`loose`). One of a pair not yet linked is loose.
    """
    c, whole = 100 - percent, 100 + percent
    other = sets.select(F.col("node").alias("centre"), F.col("shingles").alias("theirs"))
    known = centre_of.join(other, "centre")
    added, missing = F.array_except("own", "theirs"), F.array_except("theirs", "own")
    rows = members.join(known, "group").filter("node != centre").select(
        "group", "node", "usual", F.size("own").alias("n"), F.size("theirs").alias("p"),
        F.sort_array(added).alias("added"), F.sort_array(missing).alias("missing"),
    )
    apart = (F.size("added") + F.size("missing")).cast("bigint")
    rows = rows.withColumn("apart", apart)
    loose = F.lit(whole) * F.col("apart") > F.lit(c) * (F.col("n") + F.col("p"))
    shared = F.floor((whole * F.col("apart") + c * (F.col("p") - F.col("n"))) / (2 * whole))
    far = F.least(F.col("apart"), F.floor(F.lit(c) * F.col("n") / F.lit(percent)) + 1)
    near = F.least(far, F.col("apart") - F.greatest(F.lit(0), shared))
    # What only this member has comes first, then what it lacks, then what sets the centre itself apart.
    ordered = F.concat(
        F.array_except("added", "usual"), F.array_intersect("missing", "usual"),
        F.array_intersect("added", "usual"), F.array_except("missing", "usual"),
    )
    reach = F.when(loose, far).otherwise(near).cast("int")
    first = F.posexplode(F.slice(ordered, F.lit(1), reach)).alias("place", "element")
    return rows.select("group", "node", "apart", "n", loose.alias("loose"), near.alias("_near"), first).select(
        "group", "element", "node", "place", "apart", "n", (F.col("place") < F.col("_near")).alias("near"), "loose"
    )


def meetings(parts, percent):
    """Pairs (node, pivot) of different components whose differences may overlap enough for a match.

    A pair needs an overlap of a = (|D(x)| + |D(y)| - c (|x| + |y|)) / 2, so the first element they share has
    at least a - 1 others behind it on both sides.
    """
    c, whole = 100 - percent, 100 + percent
    one = parts.filter("loose").select("group", "element", "node", "component_id", "place", "apart", "n")
    two = parts.filter("near").select(
        "group", "element", F.col("node").alias("pivot"), F.col("component_id").alias("_other"),
        F.col("place").alias("_place"), F.col("apart").alias("_apart"), F.col("n").alias("_n"),
    )
    overlap = whole * (F.col("apart") + F.col("_apart")) - c * (F.col("n") + F.col("_n"))
    enough = (2 * whole * (F.col("apart") - F.col("place")) >= overlap) & (2 * whole * (F.col("_apart") - F.col("_place")) >= overlap)
    sizes = (100 * F.col("n") >= percent * F.col("_n")) & (100 * F.col("_n") >= percent * F.col("n"))
    met = (
        (one["group"] == two["group"]) & (one["element"] == two["element"]) & (F.col("component_id") != F.col("_other")) & enough & sizes
    )
    return one.join(two, met).select(F.greatest("node", "pivot").alias("node"), F.least("node", "pivot").alias("pivot")).distinct()


def find_links(sketches, docs, tables, percent=PERCENT, words=WORDS):
    """Verified links (a, b) that connect all classes a chain of matches connects."""
    pairs = band_pairs(sketches, tables)
    involved = tables.write(pairs.select(F.col("node").alias("doc_id")).union(pairs.select("pivot")).distinct(), "involved")
    texts = _plain(docs).join(involved, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    sets = tables.write(texts.mapInPandas(_sets(words), "node bigint, shingles array<bigint>"), "sets")
    links = tables.write(verified(pairs, sets, percent).select(F.col("node").alias("a"), F.col("pivot").alias("b")), "links")
    labels = components(links, tables, "first")

    def labelled(rows):
        placed = rows.join(labels, "node", "left")
        return placed.withColumn("component_id", F.coalesce("component_id", "node"))

    # A pivot and all members of its buckets; groups in one component, and pairs, are settled.
    groups = pairs.select(F.col("pivot").alias("group"), "node").union(pairs.select(F.col("pivot").alias("group"), "pivot").distinct())
    groups = tables.write(labelled(groups), "groups")
    unsettled = groups.groupBy("group").agg(
        F.count("*").alias("n"), F.min("component_id").alias("low"), F.max("component_id").alias("high")
    ).filter("n > 2 AND low < high").select("group")
    own = sets.select("node", F.col("shingles").alias("own"))
    members = groups.join(unsettled, "group", "left_semi").join(own, "node").select("group", "node", "own")
    members = tables.write(members, "members")
    centre_of = centres(members, tables)
    to_centre = members.select("group", "node").join(centre_of.select("group", F.col("centre").alias("pivot")), "group")
    to_centre = to_centre.filter("node != pivot").select("node", "pivot").distinct()

    parts = tables.write(labelled(differences(members, centre_of, sets, percent)), "differences")
    met = parts.groupBy("group", "element").agg(
        F.min("component_id").alias("low"), F.max("component_id").alias("high"), F.max("near").alias("near"), F.max("loose").alias("loose")
    ).filter("low < high AND near AND loose").select("group", "element")
    parts = tables.write(parts.join(met, ["group", "element"], "left_semi"), "meeting")
    candidates = meetings(parts, percent)
    candidates = tables.write(candidates.union(to_centre), "candidates")
    more = verified(candidates, sets, percent).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    known = labels.filter("node != component_id").select(F.col("node").alias("a"), F.col("component_id").alias("b"))
    return known.union(more)


def _spanning(batches):
    """Edges of a spanning forest of each stretch of edges, every node pointing at its root."""

    def roots(a, b):
        parent = {}

        def find(x):
            top = x
            while parent.get(top, top) != top:
                top = parent[top]
            while parent.get(x, x) != top:
                parent[x], x = top, parent[x]
            return top

        for x, y in zip(a, b):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        return nodes, [find(x) for x in nodes]

    a, b = [], []
    for batch in batches:
        a += batch["a"].tolist()
        b += batch["b"].tolist()
        if len(a) >= EDGES_AT_ONCE:
            nodes, tops = roots(a, b)
            yield pd.DataFrame({"a": nodes, "b": tops})
            a, b = [], []
    nodes, tops = roots(a, b)
    yield pd.DataFrame({"a": nodes, "b": tops}, dtype="int64")


def components(links, tables, name="all"):
    """(node, component_id) of all linked nodes: the smallest node that links reach."""
    edges = tables.write(links.mapInPandas(_spanning, "a bigint, b bigint"), f"{name}-edges-0")
    labels, step = None, 0
    while not edges.isEmpty():
        step += 1
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("_low")).select(F.col("a").alias("node"), F.least("a", "_low").alias("up"))
        up = tables.write(up, f"{name}-up-{step}")
        # Parents are never larger, so jumping ends at the root of each node's tree.
        jump = 0
        while True:
            jump += 1
            over = up.select(F.col("node").alias("up"), F.col("up").alias("_over"))
            top = F.coalesce("_over", "up")
            up = up.join(over, "up", "left").select("node", top.alias("up"), (top != F.col("up")).alias("_moved"))
            up = tables.write(up, f"{name}-up-{step}-{jump}")
            if up.filter("_moved").isEmpty():
                break
            up = up.drop("_moved")
        up = up.drop("_moved")
        if labels is None:
            labels = up.select("node", F.col("up").alias("component_id"))
        else:
            moved = up.select(F.col("node").alias("component_id"), "up")
            labels = labels.join(moved, "component_id", "left").select("node", F.coalesce("up", "component_id").alias("component_id"))
        labels = tables.write(labels, f"{name}-labels-{step}")
        to_a, to_b = up.select(F.col("node").alias("a"), F.col("up").alias("_a")), up.select(F.col("node").alias("b"), F.col("up").alias("_b"))
        rest = edges.join(to_a, "a").join(to_b, "b").select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b"))
        edges = tables.write(rest.filter("a != b").distinct(), f"{name}-edges-{step}")
    return links.sparkSession.createDataFrame([], "node bigint, component_id bigint") if labels is None else labels


def near_duplicates(docs, percent=PERCENT, words=WORDS, bands=BANDS, rows=ROWS):
    """n_shingles, component_id and kept for every document.

    Documents without words (null, empty or blank text) have no shingles and are linked with nothing.
    Texts with the same words, whatever their case (A-Z) and white space, are linked. Rows that share a
    doc_id count as one document, compared by its least text; a row without one is linked with nothing, its component_id is null
    and it is kept. Extra columns are ignored; an empty table gives an empty result.
    """
    tables = run_tables(docs, "near-dup")
    sketches = tables.write(_plain(docs).mapInPandas(_sketch(words, bands, rows), SKETCH), "sketches")
    labels = components(find_links(sketches, docs, tables, percent, words), tables)
    named = sketches.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("node"))
    placed = firsts.join(labels, "node", "left").select("digest", F.coalesce("component_id", "node").alias("component_id"))
    narrow = sketches.select("doc_id", "digest", "n_shingles")
    joined = narrow.join(placed, "digest", "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def keep_first(docs):
    """One document of each group of near copies, the one with the smallest id, with all its columns.

    Of repeated rows with one id, one stays. Documents without an id or without words all stay.
    """
    tables = run_tables(docs, "near-dup-first")
    judged = tables.write(near_duplicates(docs), "judged")
    gone = judged.filter(~F.col("kept")).select("doc_id").distinct()
    again = judged.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select("doc_id")
    gone, again = tables.write(gone, "gone"), tables.write(again, "again")
    kept = docs.join(gone, "doc_id", "left_anti")
    once = kept.join(again, "doc_id", "left_anti")
    # Rows that share an id are rare; only they move.
    repeated = kept.join(again, "doc_id", "left_semi")
    least = F.min(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("_row")
    repeated = repeated.groupBy("doc_id").agg(least).select("doc_id", "_row.*").select(*docs.columns)
    return once.select(*docs.columns).unionByName(repeated)
