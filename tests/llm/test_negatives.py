"""Hard negatives against SQL and against brute force over all pairs."""

import math
import random

import numpy as np
import pytest

from compare import assert_same
from conftest import SF
from wareloom.llm import negatives, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain_negatives(rows):
    kept = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in vector]
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, whole))
    found = set()
    for a_id, a_label, a in kept:
        if a_id % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i, label) for i, label, v in kept if i != a_id)
        for score, p, _ in [s for s in scored if s[2] == a_label][:5]:
            fitting = [s for s in scored if s[2] != a_label and 80 * -score <= 100 * -s[0] <= 100 * -score][:5]
            found |= {(a_id, p, rank, n, -score, -s) for rank, (s, n, _) in enumerate(fitting, 1)}
    return found


def mined(spark, rows):
    got = [tuple(row) for row in negatives.mine_negatives(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_query(spark, sf):
    df = queries.op12_hard_negatives(spark, sf)
    n, got, want = assert_same(df, sf, queries.CHECKS["op12_hard_negatives"])
    assert n and got == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    assert want["rank"] == "INTEGER"


def clustered(n, width, seed, zeros=0.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(7, width))
    vectors = centres[r.integers(0, 7, n)] + 0.4 * r.normal(size=(n, width))
    vectors[r.random(vectors.shape) < zeros] = 0
    return [(i * 10, [float(x) for x in v], int(r.integers(0, 3))) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("width, zeros", [(1, 0), (7, 0), (20, 0.8), (64, 0)])
def test_brute_force(spark, width, zeros, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_NUMBERS", 40 * width)  # several blocks of anchors
    rows = clustered(600, width, width, zeros)
    assert mined(spark, rows) == plain_negatives(rows)


def test_ties_and_a_hot_vector(spark):
    r = random.Random(2)
    hot = [0.5, -0.25, 0.125]
    rows = [(i, hot if i % 3 == 0 else [r.choice((0.0, 0.5, -0.5)) for _ in hot], i % 4) for i in range(900)]
    assert mined(spark, rows) == plain_negatives(rows)


def test_odd_rows(spark):
    rows = clustered(300, 6, 9)
    odd = [
        (100, None, 1), (200, [1.0, None], 1), (300, [float("nan")] * 6, 1), (400, [float("inf")] * 6, 2), (500, [0.5] * 6, None),
        (None, [0.5] * 6, 1), (600, [], 1), (700, [0.5, 0.25], 1), (800, [0.0] * 6, 2), (900, [-1.0] * 6, 0),
    ]
    odd_ids = {row[0] for row in odd}
    rows = [row for row in rows if row[0] not in odd_ids] + odd
    assert mined(spark, rows) == plain_negatives(rows)
    assert mined(spark, rows + rows[:50]) == plain_negatives(rows)
    clashing = spark.createDataFrame([(*row, 1, 2) for row in rows], SCHEMA + ", score int, rank int")
    assert {tuple(row) for row in negatives.mine_negatives(clashing).collect()} == plain_negatives(rows)
    assert negatives.mine_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mined(spark, [(1, [1.0], 1)]) == set()


def test_very_large_components_are_scored_exactly(spark):
    r = random.Random(3)
    rows = [(i * 50, [float(r.randint(-5, 5)) * 2.0**18 for _ in range(4)], i % 2) for i in range(60)]
    assert mined(spark, rows) == plain_negatives(rows)
    rows = [(i * 50, [1e30 * (i + 1)], i % 2) for i in range(6)]
    assert all(row[4] == row[5] == negatives.LONG for row in mined(spark, rows))


def test_index_leaves_out_what_norms_cover():
    r = np.random.default_rng(4)
    rows = np.floor(256 * r.normal(size=(400, 64)) / 8) * np.where(np.arange(64) < 16, 4, 0.2)
    queries_, thresholds = rows[:20], None
    q, n = negatives.suffix_norms(queries_), negatives.suffix_norms(rows)
    thresholds = 0.7 * q[:, 0] * n[:, 0].max()
    partial, level = negatives.partial_scores(queries_, rows, q, n, thresholds)
    assert level.max() < 8
    exact = queries_ @ rows.T
    bound = partial + q[:, level] * n[np.arange(400), level]
    assert (bound >= exact).all()
    assert (bound >= thresholds[:, None]).sum() < 0.2 * exact.size
