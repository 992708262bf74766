"""Hard negatives by threshold joins over an inverted index that leaves out what suffix norms cover.

Anchors meet the other rows block by block. A block of rows has an inverted index: for each group of
dimensions a list of the rows that are indexed there. By Cauchy-Schwarz the dimensions from some point
on add at most |anchor's suffix| * |row's suffix| to an inner product; where that is below every
threshold, the row has no posting. Partial scores are added up list by list, and a row whose partial
score and remaining norms reach no threshold leaves the lists that follow. What bounds still reach a
threshold is scored exactly. Thresholds start high and are lowered until the windows they serve are full.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from wareloom.llm.common import run_tables
from wareloom.operators.ordering import with_positions

POSITIVES = NEGATIVES = 5
LOWEST_PERCENT = 80
ANCHOR_EVERY = 100
SCALE = 256

GROUP = 8
STEPS = 8
# Numbers in a block of anchors that is sent to all tasks (8 MB), and of pairs or numbers looked at at once in a task.
BLOCK_NUMBERS = 1 << 20
TASK_NUMBERS = 1 << 21
ROWS_A_TASK = 4096

EXACT = float(1 << 53)
HUGE = 1e300
LONG = (1 << 63) - 1


def to_long(score):
    return max(-LONG - 1, min(LONG, int(score)))


def usable(rows):
    """vec_id, label and embedding of the rows that take part, one row per id."""
    label = F.col("label").cast("bigint")
    values = F.col("embedding").cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(
        F.col("vec_id").cast("bigint"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        values.alias("embedding"),
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.filter(finite)
    repeated = rows.groupBy("vec_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select("vec_id")
    if repeated.isEmpty():
        return rows
    least = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("_least"))
    return rows.join(repeated, "vec_id", "left_anti").unionByName(least.select("vec_id", "_least.label", "_least.embedding"))


def matrix(lists):
    """Integer components of an Arrow list array as rows of a float matrix; shorter vectors end in zeros."""
    lengths = np.diff(np.asarray(lists.offsets))
    with np.errstate(over="ignore"):
        values = np.clip(np.floor(np.asarray(lists.flatten(), np.float64) * SCALE), -HUGE, HUGE)
    filled = np.zeros((len(lengths), max(lengths, default=0)))
    filled[np.arange(filled.shape[1]) < lengths[:, None]] = values
    return filled


def widened(rows, width):
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1]))) if rows.shape[1] < width else rows


def suffix_norms(rows):
    """Norm of each row from each group of dimensions on, a little above the true value."""
    squares = np.add.reduceat(rows * rows, np.arange(0, rows.shape[1], GROUP), axis=1)
    sums = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.pad(sums, ((0, 0), (0, 1)))) * (1 + 1e-9)


class Windows:
    """The best rows of each window: scores from `lo` to `hi`, of the anchor's label or of any other."""

    def __init__(self, anchor, lo, hi, size, same):
        self.anchor, self.lo, self.hi, self.size, self.same = anchor, lo, hi, size, same
        self.scores = np.full((len(anchor), size), -np.inf)
        self.ids = np.full((len(anchor), size), np.iinfo(np.int64).max)

    def least(self):
        """Lowest score each window still takes."""
        return np.maximum(self.lo, self.scores[:, -1])

    def offer(self, w, scores, ids):
        """Scored rows of window `w`: higher scores first, then smaller ids."""
        taken = (scores >= self.least()[w]) & (scores <= self.hi[w])
        scores, ids = np.concatenate([self.scores[w], scores[taken]]), np.concatenate([self.ids[w], ids[taken]])
        best = np.lexsort((ids, -scores))[: self.size]
        self.scores[w], self.ids[w] = scores[best], ids[best]


def partial_scores(queries, rows, q_norms, r_norms, thresholds):
    """Scores over the indexed dimensions and the group from which each row is left to its norms."""
    n_groups = q_norms.shape[1] - 1
    partial = np.zeros((len(queries), len(rows)))
    level = np.zeros(len(rows), np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        covered = np.where(thresholds[:, None] > 0, thresholds[:, None] / q_norms, -np.inf).min(axis=0)
    listed = np.arange(len(rows))
    for group in range(n_groups):
        listed = listed[r_norms[listed, group] >= covered[group]]
        if not len(listed):
            break
        part = slice(group * GROUP, (group + 1) * GROUP)
        partial[:, listed] += queries[:, part] @ rows[listed, part].T
        level[listed] = group + 1
        bound = partial[:, listed] + q_norms[:, group + 1 : group + 2] * r_norms[listed, group + 1]
        listed = listed[(bound >= thresholds[:, None]).any(axis=0)]
    return partial, level


def search(anchors, windows, block):
    """Offer a block of rows (ids, labels, matrix) to all windows of a block of anchors."""
    ids, labels, rows = block
    a_ids, a_labels, queries = anchors
    width = max(rows.shape[1], queries.shape[1], 1)
    rows, queries = widened(rows, width), widened(queries, width)
    first = np.searchsorted(windows.anchor, np.arange(len(a_ids)))
    last = np.searchsorted(windows.anchor, np.arange(len(a_ids)), "right")
    here = np.flatnonzero(last > first)
    if not len(here) or not len(ids):
        return
    allowed = (labels == a_labels[here, None]) & (ids != a_ids[here, None])
    allowed = allowed if windows.same else (labels != a_labels[here, None]) & (ids != a_ids[here, None])
    queries = queries[here]
    if np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * width >= EXACT:
        whole = np.array([[int(x) for x in row] for row in rows], object).reshape(rows.shape)
        for i, query in zip(here, queries):
            exact = whole @ np.array([int(x) for x in query], object)
            fitting = np.flatnonzero(allowed[np.searchsorted(here, i)])
            for w in range(first[i], last[i]):
                windows.offer(w, np.array([float(to_long(x)) for x in exact[fitting]]), ids[fitting])
        return
    q_norms, r_norms = suffix_norms(queries), suffix_norms(rows)
    reach = q_norms[:, 0] * r_norms[:, 0].max()

    def wanted():
        least = windows.least()
        return np.array([least[first[i] : last[i]].min() for i in here])

    top = np.minimum(np.array([windows.hi[first[i] : last[i]].max() for i in here]), reach)
    low = np.maximum(wanted(), -reach)
    thresholds = np.maximum(low, top - (top - low) / STEPS)
    partial, level = partial_scores(queries, rows, q_norms, r_norms, thresholds)
    rest = np.where(np.arange(width) // GROUP < level[:, None], 0.0, rows)
    bound = partial + q_norms[:, level] * r_norms[np.arange(len(rows)), level]
    bound[~allowed] = -np.inf
    unseen = np.ones(len(here), bool)
    for step in range(1, STEPS + 1):
        least = np.maximum(wanted(), -reach)
        thresholds = least if step == STEPS else np.maximum(least, top - (top - low) * step / STEPS)
        reached = (bound >= thresholds[:, None]) & unseen[:, None]
        q, r = np.nonzero(reached)
        bound[reached] = -np.inf
        scores = partial[q, r] + np.einsum("ij,ij->i", queries[q], rest[r])
        cuts = np.searchsorted(q, np.arange(len(here) + 1))
        for i in np.unique(q):
            part = slice(cuts[i], cuts[i + 1])
            for w in range(first[here[i]], last[here[i]]):
                windows.offer(w, scores[part], ids[r[part]])
        # A window is done when its threshold is no higher than the lowest score it still takes.
        unseen &= thresholds > np.maximum(wanted(), -reach)
        if not unseen.any():
            break


def blocks(batches, n_anchors):
    """Arrow batches (vec_id, label, embedding) as blocks small enough to be held against all anchors of a part."""
    for batch in batches:
        width = max(1, max(np.diff(np.asarray(batch.column(2).offsets)), default=1))
        step = max(1, TASK_NUMBERS // (4 * max(width, n_anchors)))
        for start in range(0, batch.num_rows, step):
            ids, labels, lists = batch.slice(start, step).columns
            yield np.asarray(ids), np.asarray(labels), matrix(lists)


def searched(rows, anchors, windows):
    """Rows (anchor, lo, vec_id, score): for each window the best rows of each task."""
    shared = rows.sparkSession.sparkContext.broadcast((anchors, windows))

    def task(batches):
        (a_ids, a_labels, queries), (anchor, lo, hi, size, same) = shared.value
        found = Windows(anchor, lo, hi, size, same)
        part = 256
        for block in blocks(batches, min(part, len(a_ids))):
            for start in range(0, len(a_ids), part):
                own = slice(*np.searchsorted(anchor, [start, start + part]))
                if own.start == own.stop:
                    continue
                some = Windows(anchor[own] - start, lo[own], hi[own], size, same)
                some.scores, some.ids = found.scores[own], found.ids[own]
                chosen = slice(start, start + part)
                search((a_ids[chosen], a_labels[chosen], queries[chosen]), some, block)
        w, place = np.nonzero(found.scores > -np.inf)
        scores = [to_long(score) for score in found.scores[w, place]]
        yield pa.record_batch(
            {
                "window": pa.array(w, pa.int64()),
                "vec_id": pa.array(found.ids[w, place], pa.int64()),
                "score": pa.array(scores, pa.int64()),
            }
        )

    return rows.mapInArrow(task, "window bigint, vec_id bigint, score bigint")


def best_of(found, size):
    order = Window.partitionBy("window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def anchor_block(rows):
    """Ids, labels and components of a bounded block of anchors, in order of id."""
    table = rows.orderBy("vec_id").toArrow().combine_chunks()
    lists = table.column(2).combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64()))
    return np.asarray(table.column(0)), np.asarray(table.column(1)), matrix(lists)


def mine_negatives(embeddings):
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, as the contract has them.

    Rows without label, vector or id, or with a missing or non-finite component, take no part; of rows
    with one id the least by label and vector counts. A shorter vector counts as ending in zeros.
    Scores are exact while they fit 53 bits; beyond that they are the nearest such number, at most 64 bits.
    An anchor without positives, or a positive without a row in its window, has no result. Extra columns
    are ignored; an empty table gives an empty result.
    """
    tables = run_tables(embeddings, "negatives")
    rows = tables.write(usable(embeddings), "rows")
    anchors = rows.filter(F.col("vec_id") % ANCHOR_EVERY == 0)
    size = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    anchors = tables.write(with_positions(anchors, ["vec_id"], "place", tables=tables), "anchors")
    # Tasks of some thousand rows: each returns a few rows per window, so their number follows the input's rows.
    dealt = rows.coalesce(max(1, -(-size[0] // ROWS_A_TASK)))
    a_block = max(1, BLOCK_NUMBERS // max(1, size[1] or 1))
    n_blocks = -(-anchors.count() // a_block)
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark = embeddings.sparkSession
    if not n_blocks:
        return spark.createDataFrame([], schema)
    for number in range(n_blocks):
        inside = F.col("place").between(number * a_block + 1, (number + 1) * a_block)
        block = anchor_block(anchors.filter(inside).select("vec_id", "label", "embedding"))
        mined = _mined(dealt, block, tables, number)
        mined.write.mode("overwrite").parquet(f"{tables.path('mined')}/block={number}")
    return spark.read.schema(schema).parquet(tables.path("mined")).select(*[part.split()[0] for part in schema.split(", ")])


def _mined(rows, block, tables, number):
    """Results of one block of anchors: first their positives, then a window below each of these."""
    ids = block[0]
    every = np.arange(len(ids))
    everything = np.full(len(ids), np.inf)
    found = searched(rows, block, (every, -everything, everything, POSITIVES, True))
    positives = tables.write(best_of(found, POSITIVES), f"positives-{number}")
    # At most POSITIVES rows per anchor of the block.
    listed = sorted((row.window, row.rank, row.vec_id, row.score) for row in positives.collect() if row.score >= 0)
    anchor = np.array([row[0] for row in listed], np.int64)
    hi = np.array([row[3] for row in listed], float)
    lo = np.array([-(-LOWEST_PERCENT * row[3] // 100) for row in listed], float)
    found = best_of(searched(rows, block, (anchor, lo, hi, NEGATIVES, False)), NEGATIVES)
    named = [(w, int(ids[row[0]]), row[2], row[3]) for w, row in enumerate(listed)]
    named = rows.sparkSession.createDataFrame(named, "window bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
    return found.join(F.broadcast(named), "window").select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
