"""Subword lattice likelihoods against sums over all segmentations, and held-out text against junk."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from corpus_fixtures import no_docs, odd_docs  # noqa: F401
from wareloom.llm import likelihood, queries


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        low = low.replace(blank, " ")
    return [word.encode() for word in low.split(" ") if word]


def held_out(doc_id):
    return crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def plain_base(rows):
    """Columns of the contract's base, one row of the input after the other."""
    counts, end = Counter(), 0
    for doc_id, text in rows:
        if not held_out(doc_id):
            counts.update(plain_words(text))
            end += 1
    total, distinct = sum(counts.values()) + end, len(counts) + (end > 0)
    result = []
    for doc_id, text in rows:
        c = [counts[word] for word in plain_words(text)] + [end]
        base = math.fsum(math.log10((n + 0.1) / (total + 0.1 * (distinct + 1))) for n in c)
        result.append((doc_id, held_out(doc_id), len(c), sum(n > 0 for n in c), total, base))
    return result


def all_segmentations(pieces, word):
    """Every way to write a word as pieces, one by one."""
    texts = {piece.replace("▁", " "): i for i, piece in enumerate(pieces.texts) if i not in set(pieces.bytes)}

    def cut(text):
        if not text:
            yield ()
            return
        for n in range(1, len(text) + 1):
            if text[:n] in texts:
                yield from ((texts[text[:n]], *rest) for rest in cut(text[n:]))
        yield from ((*(pieces.bytes[b] for b in text[0].encode()), *rest) for rest in cut(text[1:]))

    return list(cut(" " + word.decode()))


WORDS = [b"the", b"banana", b"queue|", b"\xc3\xa9t\xc3\xa9", b"q", "▁▁".encode(), "語x".encode(), b"<0x41>"]


@pytest.mark.parametrize("word", WORDS)
def test_forward_sums_all_segmentations(word):
    pieces = likelihood.pieces_of()
    scores = pieces.scores
    ways = all_segmentations(pieces, word)
    plain = math.log(math.fsum(math.exp(math.fsum(scores[i] for i in way)) for way in ways))
    together = likelihood.log_probabilities(pieces, scores, [b"some", word, b"", word, b"word"])
    assert together[1] == together[3] == pytest.approx(plain, rel=1e-12)
    counts = np.zeros(len(pieces))
    likelihood.add_expected(pieces, scores, [word, word], [1, 2], counts)
    expected = Counter()
    for way in ways:
        share = 3 * math.exp(math.fsum(scores[i] for i in way) - plain)
        for i in way:
            expected[i] += share
    assert {i: n for i, n in enumerate(counts) if n} == pytest.approx(dict(expected), rel=1e-9)


def test_pieces_are_a_distribution():
    pieces = likelihood.pieces_of()
    assert math.fsum(math.exp(x) for x in pieces.scores) == pytest.approx(1)
    assert len(set(pieces.bytes)) == 256


def test_very_long_word():
    pieces = likelihood.pieces_of()
    one, other = likelihood.log_probabilities(pieces, pieces.scores, [b"x" * 50_000, b"y"])
    assert -10 * 50_000 < one < other < 0
    assert likelihood.log_probabilities(pieces, pieces.scores, []).tolist() == []


def plain_scores(rows, learned):
    """Scores of whole texts by the lattice of each of their words, with scores learned here."""
    pieces = likelihood.pieces_of()
    known = sorted({word for _, text in rows for word in plain_words(text)})
    found = dict(zip(known, likelihood.log_probabilities(pieces, learned, known)))
    return [(sum(found[word] for word in plain_words(text)) + learned[pieces.end]) / math.log(10) for _, text in rows]


def plain_learned(rows):
    pieces = likelihood.pieces_of()
    counts = Counter()
    for doc_id, text in rows:
        if not held_out(doc_id):
            counts.update(plain_words(text))
    scores = pieces.scores
    for _ in range(likelihood.ROUNDS):
        expected = np.zeros(len(pieces))
        likelihood.add_expected(pieces, scores, list(counts), list(counts.values()), expected)
        expected[pieces.end] = sum(not held_out(doc_id) for doc_id, _ in rows)
        weights = expected + likelihood.PRIOR * np.exp(pieces.scores)
        scores = np.log(weights / weights.sum())
    return scores


def check(got, rows):
    key = lambda row: (row[0] is None, row[0] or 0, row[2], round(row[5], 6))
    expected = [(*base, score) for base, score in zip(plain_base(rows), plain_scores(rows, plain_learned(rows)))]
    got, expected = sorted(map(tuple, got), key=key), sorted(expected, key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_query(spark, monkeypatch):
    df = queries.op13_lm_scoring(spark, SF)
    assert df.dtypes == [
        ("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"),
        ("base_score", "double"), ("score", "double"),
    ]
    rows = [tuple(row) for row in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(df.collect(), rows)
    # The same with most words joined instead of sent along, and long ones salted.
    monkeypatch.setattr(likelihood, "KNOWN_WORDS", 40)
    monkeypatch.setattr(likelihood, "KNOWN_BYTES", 5)
    check(queries.op13_lm_scoring(spark, SF).collect(), rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(row.doc_id, row.text) for row in odd_docs.collect()]
    check(likelihood.score_documents(odd_docs).collect(), rows)
    assert likelihood.score_documents(no_docs).count() == 0
    only = spark.createDataFrame([(i, "some words here") for i in range(60) if held_out(i)], "doc_id bigint, text string")
    got = likelihood.score_documents(only).collect()
    assert got and all(row.held_out and row.n_known == 0 and row.train_tokens == 0 and row.score < 0 for row in got)


def test_held_out_text_is_likelier_than_the_same_letters_shuffled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    r = random.Random(4)
    rows = [(row.doc_id, row.text) for row in docs.collect()]
    chosen = [(i, text) for i, text in rows if held_out(i) and text and len(text) < 4000]

    def shuffled(word):
        return "".join(r.sample(word, len(word)))

    junk = [(i + 10_000_000, " ".join(map(shuffled, text.split()))) for i, text in chosen]
    learned = plain_learned(rows)
    before, after = plain_scores(chosen, learned), plain_scores(junk, learned)
    assert sum(a > b for a, b in zip(before, after)) > 0.95 * len(chosen)
    # Training makes held-out text likelier than the vocabulary's own scores do.
    untrained = plain_scores(chosen, likelihood.pieces_of().scores)
    assert sum(before) > sum(untrained)
