"""Spelling variants against brute force over all pairs of words."""

import random
import re
from collections import Counter
from itertools import combinations
from zlib import crc32

from conftest import SF
from corpus_fixtures import no_docs, odd_docs  # noqa: F401
from wareloom.llm import queries, spelling


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {word: n for word, n in counts.items() if len(word) >= 7 and n >= 2}


def shorter(word):
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and short in shorter(long)


def plain_variants(counts):
    """The same rows by looking at every word reached from a word by one edit."""
    by_gap = {}
    for word in counts:
        for i in range(len(word)):
            by_gap.setdefault((word[:i], word[i + 1 :]), []).append(word)
    linked = {word: set() for word in counts}
    for group in by_gap.values():
        for a, b in combinations(group, 2):
            linked[a].add(b)
            linked[b].add(a)
    for word in counts:
        for other in shorter(word) & counts.keys():
            linked[word].add(other)
            linked[other].add(word)
    form = {}
    for word, others in linked.items():
        others.discard(word)
        assert all(near(word, other) for other in others)
        best = min(others, key=lambda other: (-counts[other], other), default=None)
        form[word] = best if best is not None and counts[best] >= 10 * counts[word] else None
    rows = set()
    for word, n in counts.items():
        root = word
        while form[root]:
            root = form[root]
        rows.add((word, form[word], root, n, len(linked[word]), counts[form[word]] if form[word] else None))
    return rows


def result(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_query(spark):
    docs = [tuple(row) for row in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op11_spelling(spark, SF)
    assert [name for name, _ in rows.dtypes] == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = plain_variants(plain_words(docs))
    got = rows.collect()
    assert len(got) == len(expected)
    assert {tuple(row) for row in got} == expected


def crowded_words():
    """Words that differ in every way one edit allows, runs of equal letters among them, over a small alphabet."""
    r = random.Random(5)
    words = {"".join(r.choices("abé", k=r.randint(7, 9))) for _ in range(1500)}
    words |= {"aaaaaaa" + c + "bbbb" for c in "abcdefghijklmnopqrstuvwxyzéÿ"} | {"aaaaaaabbbb", "aaaaaaa", "aaaaaaaa"}
    words |= {"z" * 3000 + c for c in "xyz"}
    return sorted(words)


def test_crowded_words_and_chains(spark):
    r = random.Random(6)
    rows = []
    for word in crowded_words():
        rows.extend((len(rows), " ".join([word] * n)) for n in [r.choice((2, 2, 3, 25, 300))])
    # A chain of forms: each step is ten times as frequent.
    for n, word in ((3, "chained"), (30, "chainedd"), (300, "chaineddd"), (3000, "chainedddd")):
        rows.append((len(rows), f"{word.upper()}\n" * n))
    expected = plain_variants(plain_words(rows))
    assert any(root == "chainedddd" and word == "chained" for word, _, root, *_ in expected) or len(expected) > 1000
    for partitions in ("3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            docs = spark.createDataFrame(rows, "doc_id bigint, text string")
            assert result(spelling.spelling_variants(docs)) == expected
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(odd_docs, no_docs):
    rows = [(row.doc_id, row.text) for row in odd_docs.collect()]
    got = spelling.spelling_variants(odd_docs.unionByName(odd_docs)).collect()
    assert {tuple(row) for row in got} == plain_variants(plain_words(rows + rows))
    assert spelling.spelling_variants(no_docs).count() == 0


def test_nodes_are_one_whatever_the_cuts():
    words = sorted({"".join(random.Random(i).choices("ab", k=random.Random(i).randint(1, 8))) for i in range(300)})
    r = random.Random(1)
    for _ in range(30):
        cuts = sorted(r.sample(range(1, len(words)), r.randint(0, 12)))
        parts = [words[a:b] for a, b in zip([0, *cuts], [*cuts, len(words)])]
        shared = spelling.spine([(i, part[0], part[-1]) for i, part in enumerate(parts)])
        numbers = {}
        for i, part in enumerate(parts):
            none = ("", [])
            paths = spelling.numbered_path(iter(part), i, shared.get(i, none), shared.get(i + 1, none))
            for word, path in zip(part, paths, strict=True):
                others = max((spelling.common_prefix(word, w) for w in words if w != word), default=0)
                assert len(path) == others + 1
                for depth, node in enumerate(path):
                    assert numbers.setdefault(word[:depth], node) == node
        assert len(set(numbers.values())) == len(numbers)
