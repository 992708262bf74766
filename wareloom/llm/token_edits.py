"""Edit-aware token counts: a segment tree of pre-token counts per document.

A text is a row of pieces (blanks and the word after them) whose tokens do not depend on each
other. The tree holds characters and tokens of every piece, summed upwards. An edit finds its
pieces by descending, re-encodes them with one piece of context on either side, and updates the
sums above them. Nothing else of the document is encoded again.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wareloom.llm.common import ship_code
from wareloom.llm.tokenizing import TOKENIZER, tokenizer_for

LEAF = 32

COUNTED = "doc_id bigint, n_chars bigint, n_tokens bigint"
TREES = "doc_id bigint, text string, lengths array<int>, counts array<int>, n_tokens bigint"
EDIT = "array<struct<start:bigint,removed:bigint,added:string>>"
EDITED = (
    "doc_id bigint, n_edits bigint, n_chars_before bigint, n_chars bigint, n_tokens_before bigint, n_tokens bigint, "
    "n_pieces bigint, n_reencoded bigint, text string"
)


class PieceTree:
    """Segment tree over leaves of up to a few dozen pieces, with sums of characters, tokens and pieces."""

    def __init__(self, lengths, counts):
        self._build(list(zip(lengths, counts)))

    def _build(self, pieces):
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.base = 1
        while self.base < len(self.leaves):
            self.base *= 2
        self.sums = np.zeros((2 * self.base, 3), np.int64)
        for i, leaf in enumerate(self.leaves):
            self.sums[self.base + i] = self._sum(leaf)
        for node in range(self.base - 1, 0, -1):
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    @staticmethod
    def _sum(leaf):
        return (sum(n for n, _ in leaf), sum(t for _, t in leaf), len(leaf))

    @property
    def chars(self):
        return int(self.sums[1][0])

    @property
    def tokens(self):
        return int(self.sums[1][1])

    @property
    def size(self):
        return int(self.sums[1][2])

    def piece_at(self, position):
        """(piece number, its first character) of the piece holding character `position`, or of the last one."""
        position = min(position, self.chars - 1)
        node, chars, number = 1, 0, 0
        while node < self.base:
            node *= 2
            if chars + self.sums[node][0] <= position:
                chars += int(self.sums[node][0])
                number += int(self.sums[node][2])
                node += 1
        for length, _ in self.leaves[node - self.base]:
            if chars + length > position:
                break
            chars += length
            number += 1
        return number, chars

    def _leaf_of(self, number):
        node = 1
        while node < self.base:
            node *= 2
            if self.sums[node][2] <= number:
                number -= int(self.sums[node][2])
                node += 1
        return node - self.base, number

    def span(self, number):
        """(first character, length) of a piece."""
        node, chars = 1, 0
        rest = number
        while node < self.base:
            node *= 2
            if self.sums[node][2] <= rest:
                rest -= int(self.sums[node][2])
                chars += int(self.sums[node][0])
                node += 1
        leaf = self.leaves[node - self.base]
        return chars + sum(n for n, _ in leaf[:rest]), leaf[rest][0]

    def replace(self, first, last, pieces):
        """Put `pieces` in place of the pieces first .. last - 1, and update the sums above them."""
        if not self.size:
            self._build(pieces)
            return
        i, inside = self._leaf_of(min(first, self.size - 1))
        if first == self.size:
            inside = len(self.leaves[i])
        gone, at, touched = last - first, i, []
        leaf = self.leaves[i]
        here = min(gone, len(leaf) - inside)
        leaf[inside : inside + here] = pieces
        touched.append(i)
        gone -= here
        while gone:
            at += 1
            here = min(gone, len(self.leaves[at]))
            del self.leaves[at][:here]
            touched.append(at)
            gone -= here
        if len(leaf) > 8 * LEAF:
            self._build([piece for part in self.leaves for piece in part])
            return
        for i in touched:
            node = self.base + i
            self.sums[node] = self._sum(self.leaves[i])
            while node > 1:
                node //= 2
                self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def arrays(self):
        flat = [piece for leaf in self.leaves for piece in leaf]
        return [n for n, _ in flat], [t for _, t in flat]


def plant(text, tokenizer):
    """The tree of a whole text."""
    pieces = tokenizer.pieces(text)
    return PieceTree([len(piece) for piece in pieces], [tokenizer.count(piece) for piece in pieces])


def edit(text, tree, start, removed, added, tokenizer):
    """Apply one edit; returns (new text, pieces encoded again). Places beyond the end mean the end."""
    start = min(max(start, 0), len(text))
    end = min(start + max(removed, 0), len(text))
    if start == end and not added:
        return text, 0
    if not tree.size:
        first = last = begin = stop = 0
    else:
        first, _ = tree.piece_at(start)
        last, _ = tree.piece_at(max(end - 1, start))
        first, last = max(first - 1, 0), min(last + 1, tree.size - 1)
        begin = tree.span(first)[0]
        stop = sum(tree.span(last))
        last += 1
    region = text[begin:start] + added + text[end:stop]
    pieces = tokenizer.pieces(region)
    tree.replace(first, last, [(len(piece), tokenizer.count(piece)) for piece in pieces])
    return text[:start] + added + text[end:], len(pieces)


def _number(value):
    return None if pd.isna(value) else int(value)


def plant_trees(docs, tokenizer=TOKENIZER):
    """Trees of all documents as a table to be stored: piece lengths and token counts next to the text."""

    def run(batches):
        encoder = tokenizer_for(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                tree = plant(text or "", encoder)
                rows.append((_number(doc_id), text or "", *tree.arrays(), tree.tokens))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "lengths", "counts", "n_tokens"]).astype({"doc_id": "Int64"})

    ship_code(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return narrow.mapInPandas(run, TREES)


def _edited(tokenizer, stored):
    def run(batches):
        encoder = tokenizer_for(tokenizer)
        for batch in batches:
            rows = []
            parts = (batch["lengths"], batch["counts"]) if stored else (batch["text"], batch["text"])
            for doc_id, text, edits, lengths, counts in zip(batch["doc_id"], batch["text"], batch["edits"], *parts):
                text = text or ""
                tree = PieceTree(list(lengths), list(counts)) if stored else plant(text, encoder)
                before, chars, again = tree.tokens, len(text), 0
                edits = [one for one in (edits if edits is not None else []) if one is not None]
                for one in edits:
                    text, n = edit(text, tree, one["start"] or 0, one["removed"] or 0, one["added"] or "", encoder)
                    again += n
                rows.append((_number(doc_id), len(edits), chars, len(text), before, tree.tokens, tree.size, again, text))
            names = [part.split()[0] for part in EDITED.split(", ")]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return run


def edit_trees(trees, tokenizer=TOKENIZER):
    """Token counts after the edits in the `edits` column of stored trees, without encoding the rest again."""
    ship_code(trees.sparkSession)
    narrow = trees.select("doc_id", "text", "lengths", "counts", F.col("edits").cast(EDIT))
    return narrow.mapInPandas(_edited(tokenizer, True), EDITED)


def count_after_edits(docs, tokenizer=TOKENIZER):
    """Token counts of documents before and after their `edits`, each tree planted and used in one task.

    Edits apply in order, each to the text the last one left; starts and lengths are in code points,
    places beyond the end mean the end, null edits and null fields do nothing. A document without
    text is empty and can be edited. Repeated rows are counted one by one, a null doc_id stays null,
    extra columns are ignored and an empty table gives an empty result. Map-only: nothing is shuffled.
    """
    ship_code(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("edits").cast(EDIT))
    return narrow.mapInPandas(_edited(tokenizer, False), EDITED)


def revisions(text):
    """Three edits of each text, made from the text itself: a word put in, a stretch replaced, a stretch removed."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("bigint")
    mark = F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0))

    def place(divisor):
        return F.pmod(F.floor(mark / divisor), F.greatest(n, F.lit(1))).cast("bigint")

    def one(start, removed, added):
        return F.struct(start.alias("start"), F.lit(removed).cast("bigint").alias("removed"), added.alias("added"))

    return F.array(
        one(place(1), 0, F.lit(" revised 12")),
        one(place(7), 9, F.coalesce(F.substr(text, F.lit(3), F.lit(14)), F.lit(""))),
        one(place(49), 25, F.lit("")),
    ).cast(EDIT)
