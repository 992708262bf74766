"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Texts are lower-cased, homoglyphs and digit substitutions folded, and words set off by single
blanks. The lexicon holds words and word stems with a weight each, learned from labelled rows; its
patterns and the exception phrases sit in one automaton. A hit inside an exception phrase does
not count. The sum of weights, normalised by the length of the text, becomes a score between 0 and 1.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wareloom.llm.common import run_tables

THRESHOLD = 0.7
# Bounds of the training sample, in labelled documents of each class, and of the lexicon.
SAMPLE_TOXIC = 4_000
SAMPLE_CLEAN = 8_000
LEXICON = 2_000
STEMS = (4, 5, 6, 7)
MIN_DOCS = 2

# Look-alike letters, and digits and signs that stand for letters.
HOMOGLYPHS = str.maketrans(
    "аеорсухіјѕԁɡһкмтвнαοερτυνικ０１３４５７",
    "aeopcyxijsdghkmtbhaoeptuvik013457",
)
SUBSTITUTES = str.maketrans("013457@$!", "oieastasi")
# Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "clown fish", "trash bin", "stupid simple")

_WORD = re.compile(r"[\w@$!]+")
_DISGUISED = re.compile(r"[013457@$!]")

SCORED = "n_words bigint, n_hits bigint, weight double, score double"


def fold(text):
    """Folded words of a text joined by single blanks, with one at either end."""
    words = _WORD.findall(text.lower().translate(HOMOGLYPHS))
    if _DISGUISED.search(text):
        words = [_unmask(word) if _DISGUISED.search(word) else word for word in words]
    return " " + " ".join(words) + " ", len(words)


def _unmask(word):
    word = word.rstrip("!") or word
    return word.translate(SUBSTITUTES) if any(letter.isalpha() for letter in word) else word


def terms(text):
    """Patterns of a folded text: whole words (` word `) and word stems (` stem`)."""
    found = set()
    for word in set(text.split()):
        if 3 <= len(word) <= 24 and not word.isdigit():
            found.add(f" {word} ")
            found.update(f" {word[:n]}" for n in STEMS if len(word) > n)
    return found


def _count_terms(batches):
    counts = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"]):
            counts[int(toxic)].update(terms(fold(text or "")[0]))
    rows = [(term, n, counts[0].get(term, 0)) for term, n in counts[1].items()]
    rows += [(term, 0, n) for term, n in counts[0].items() if term not in counts[1]]
    for start in range(0, len(rows), 50_000):
        yield pd.DataFrame(rows[start : start + 50_000], columns=["term", "n_toxic", "n_clean"])


def lexicon_from(sample, n_toxic, n_clean, exceptions=EXCEPTIONS, limit=LEXICON):
    """{pattern: weight}: terms that mark toxic rows, by smoothed log odds of document counts.

    A term that a shorter one already stands for, with as many toxic rows and no more clean ones, is
    left out, so a stem replaces its words and a word its own longer stems.
    """
    counted = sample.mapInPandas(_count_terms, "term string, n_toxic bigint, n_clean bigint")
    odds = F.log((F.col("n_toxic") + 0.1) / (n_toxic + 0.2)) - F.log((F.col("n_clean") + 0.5) / (n_clean + 1.0))
    least = max(MIN_DOCS, n_toxic // 200)
    kept = (
        counted.groupBy("term")
        .agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
        .withColumn("weight", odds)
        .filter((F.col("n_toxic") >= least) & (F.col("n_clean") * 200 <= F.col("n_toxic") * max(1.0, n_clean / max(n_toxic, 1))))
        .filter(F.col("weight") > math.log(8))
        .orderBy(F.desc(F.col("weight") * F.sqrt("n_toxic")), "term")
        .limit(limit)
        .collect()
    )
    rows = {row["term"]: row for row in kept}
    lexicon = {}
    for term, row in rows.items():
        stems = [f" {term.strip()[:n]}" for n in STEMS if len(term.strip()) > n or (term.endswith(" ") and len(term.strip()) == n)]
        covered = any(
            stem in rows and stem != term and rows[stem]["n_clean"] <= row["n_clean"] + rows[stem]["n_toxic"] // 200
            for stem in stems
        )
        if not covered:
            lexicon[term] = float(row["weight"])
    return lexicon


def automaton(lexicon, exceptions=EXCEPTIONS):
    """Aho-Corasick automaton of lexicon patterns and exception phrases; None when both are empty."""
    built = ahocorasick.Automaton()
    for phrase in exceptions:
        built.add_word(f" {phrase} ", (len(phrase) + 2, None))
    for pattern, weight in lexicon.items():
        built.add_word(pattern, (len(pattern), weight))
    if not len(built):
        return None
    built.make_automaton()
    return built


def matched(folded, built):
    """(hits, sum of weights) outside exception phrases; each word counts once, with its highest weight."""
    if built is None:
        return 0, 0.0
    best, excused = {}, []
    for end, (length, weight) in built.iter(folded):
        start = end - length + 1
        if weight is None:
            excused.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    kept = [w for start, w in best.items() if not any(low <= start < high for low, high in excused)]
    return len(kept), float(sum(kept))


def features(weight, hits, words):
    """What the score sees of a text: weight against its length, and whether anything was hit."""
    return (math.log1p(weight), math.log1p(1000.0 * weight / (words + 100.0)), 1.0 if hits else 0.0)


def score_of(model, weight, hits, words):
    z = model[0] + sum(a * b for a, b in zip(model[1:], features(weight, hits, words)))
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def fit_logistic(x, y, rounds=60, ridge=1e-2):
    """Weights of a small logistic regression by Newton's method; one class only gives its rate."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        return [float(np.log(rate / (1 - rate))), *[0.0] * (x.shape[1] if x.ndim == 2 else 3)]
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


class Model:
    """A learned lexicon with its score; small, so it travels in the closure of the tasks."""

    def __init__(self, lexicon, weights, exceptions=EXCEPTIONS):
        self.lexicon, self.weights, self.exceptions = lexicon, weights, exceptions


def is_held_out(doc_id):
    """Rows no label is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs, labels, exceptions=EXCEPTIONS, sample_toxic=SAMPLE_TOXIC, sample_clean=SAMPLE_CLEAN):
    """Learn lexicon and score from labelled rows outside the held-out third.

    At most `sample_toxic` and `sample_clean` rows of each class are used, those first by a hash of
    their id; repeated or contradicting labels of a document count as toxic if any says so.
    """
    tables = run_tables(docs, "toxicity")
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int"))
        .filter(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    order = F.xxhash64("doc_id")
    chosen = tables.write(
        known.filter("toxic = 1").orderBy(order).limit(sample_toxic).unionByName(
            known.filter("toxic = 0").orderBy(order).limit(sample_clean)
        ),
        "chosen",
    )
    # At most sample_toxic + sample_clean rows of two numbers, a proven bound for the broadcast.
    wanted = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    sample = tables.write(wanted, "sample")
    n = {row["toxic"]: row["count"] for row in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic:
        return Model({}, fit_logistic(np.zeros((n_clean, 3)), np.zeros(n_clean)), exceptions)
    lexicon = lexicon_from(sample, n_toxic, n_clean, exceptions)
    # One numeric row per sampled document reaches the driver.
    score = scorer(Model(lexicon, [0.0] * 4, exceptions))
    seen = sample.select("toxic", score("text").alias("_s")).select("toxic", "_s.*").collect()
    x = np.array([features(row["weight"], row["n_hits"], row["n_words"]) for row in seen]).reshape(-1, 3)
    y = np.array([row["toxic"] for row in seen], float)
    return Model(lexicon, fit_logistic(x, y), exceptions)


def scorer(model):
    """A column function: number of words, hits, weight and score of each whole text."""

    @F.pandas_udf(SCORED)
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        built = automaton(model.lexicon, model.exceptions)
        for batch in texts:
            rows = []
            for text in batch:
                folded, words = fold(text or "")
                hits, weight = matched(folded, built)
                rows.append((words, hits, weight, score_of(model.weights, weight, hits, words)))
            yield pd.DataFrame(rows, columns=["n_words", "n_hits", "weight", "score"])

    return scored.asNondeterministic()  # so that it runs once, whatever reads its fields


def score_toxicity(docs, labels, threshold=THRESHOLD):
    """doc_id, held_out, score and predicted for every document.

    Empty and missing texts score like any text without a hit. Repeated rows score alike; a null
    doc_id is scored and counts as not held out. Without toxic labels to learn from, every text gets
    the same low score. Extra columns are ignored; an empty table gives an empty result.
    """
    score = scorer(train(docs, labels))
    rows = docs.select(F.col("doc_id").cast("bigint"), score(F.col("text").cast("string")).alias("_s"))
    return rows.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        F.col("_s.score").alias("score"),
        (F.col("_s.score") >= threshold).cast("int").alias("predicted"),
        F.col("_s.n_hits").alias("n_hits"),
    )


def drop_toxic(docs, labels, threshold=THRESHOLD):
    """The documents that score below the threshold, with all their columns."""
    score = scorer(train(docs, labels))
    marked = docs.withColumn("_toxicity", score(F.col("text").cast("string")))
    return marked.filter(F.col("_toxicity.score") < threshold).drop("_toxicity")
