"""Document probabilities from the lattices of all segmentations of its words into subword pieces.

The pieces are those of a public vocabulary, which is used as it is. A text is the sequence of its words
and one end; no piece reaches over a blank, so the probability of a text is the product of those of its
words, each the sum over all ways to cut it into pieces, taken by a forward recursion in log space. Piece
probabilities start from the scores of the vocabulary and are re-estimated from the expected counts of
the training words, with the vocabulary's own distribution as a prior.
"""

import math
from collections import Counter
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

from wareloom.llm.common import run_tables
from wareloom.operators.joins import lookup_join

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
HELD_OUT_ONE_IN = 10
ADDED = 0.1

ROUNDS = 3
# Tokens of prior weight, spread over the pieces as the vocabulary's scores have them.
PRIOR = 1000.0

# The most frequent words go to every task as a table of at most KNOWN_WORDS * KNOWN_BYTES bytes (6 MB).
KNOWN_WORDS = 100_000
KNOWN_BYTES = 64
# Distinct words a task counts before it hands them on; bounds its memory.
COUNTED = 200_000

# Bytes of words whose lattices a task looks at side by side.
PART_BYTES = 50_000

START = " "
_CHAR_BITS = 21
LOG10 = math.log(10)
_LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Pieces:
    """The pieces of a vocabulary file that can be part of a word, its 256 bytes and the end.

    `scores` are the vocabulary's own log probabilities: the scores of its pieces fall by one with each
    rank, so that a piece of rank r has a share in proportion to 1 / r, as in natural text; bytes come last.
    """

    def __init__(self, path=VOCABULARY):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts, shares, bytes_ = [], [], {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i) or "▁" in piece[1:]:
                continue
            if model.is_byte(i):
                bytes_[int(piece[3:5], 16)] = len(self.texts)
            self.texts.append(piece)
            shares.append(1.0 / (1.0 - model.get_score(i)) if not model.is_byte(i) else 0.0)
        least = min(share for share in shares if share)
        self.bytes = [bytes_[b] for b in range(256)]
        self.end = len(self.texts)
        shares = np.array([share or least for share in shares] + [max(shares)])
        self.scores = np.log(shares / shares.sum())
        self._number_trie()

    def _number_trie(self):
        """Trie of the pieces as arrays: (node, character) in order, the node each leads to, the piece that ends there."""
        spelled = set(self.bytes)
        nodes, ends = {}, [-1]
        for i, text in enumerate(self.texts):
            if i in spelled:
                continue
            node = 0
            for char in text.replace("▁", START):
                key = (node << _CHAR_BITS) | ord(char)
                if key not in nodes:
                    nodes[key] = len(ends)
                    ends.append(-1)
                node = nodes[key]
            ends[node] = i
        self.keys = np.array(sorted(nodes), np.int64)
        self.children = np.array([nodes[key] for key in self.keys.tolist()], np.int64)
        self.ends = np.array(ends, np.int64)

    def __len__(self):
        return self.end + 1


class Lattices:
    """The lattices of some words (bytes) side by side: arcs from place to place, in order of the place they end at.

    The first place of a word is before the blank that begins it. An arc is a piece, or one character
    spelled by its bytes, so every word has a segmentation; `piece` is then the negative of the place of the
    character in `characters`, less one.
    """

    def __init__(self, pieces, words):
        texts = [START + word.decode("utf-8", "surrogatepass") for word in words]
        lengths = np.array([len(text) for text in texts], np.int64)
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(texts)), lengths)
        stops = np.cumsum(lengths)
        self.first = stops - lengths + np.arange(len(texts))
        self.last = self.first + lengths
        self.characters, spelled = np.unique(chars, return_inverse=True)
        starts = np.arange(len(chars))
        found = [(starts, starts + 1, -1 - spelled)]
        node, place, stop = np.zeros(len(chars), np.int64), starts, stops[word]
        while len(starts):
            inside = place < stop
            starts, node, place, stop = starts[inside], node[inside], place[inside], stop[inside]
            keys = (node << _CHAR_BITS) | chars[place]
            at = np.minimum(np.searchsorted(pieces.keys, keys), len(pieces.keys) - 1)
            on = pieces.keys[at] == keys
            starts, node, place, stop = starts[on], pieces.children[at[on]], place[on] + 1, stop[on]
            whole = pieces.ends[node] >= 0
            found.append((starts[whole], place[whole], pieces.ends[node[whole]]))
        starts, ends, self.piece = (np.concatenate(part) for part in zip(*found))
        # Places are numbered word by word, with one more than characters in each.
        owner = word[starts]
        depth = ends - (stops - lengths)[owner]
        order = np.lexsort((ends, depth))
        self.start, self.end, self.piece = (starts + owner)[order], (ends + owner)[order], self.piece[order]
        cuts = np.searchsorted(depth[order], np.arange(1, lengths.max(initial=0) + 2))
        self.depths = list(zip(cuts[:-1], cuts[1:]))

    def arc_scores(self, pieces, scores):
        spelled = [sum(scores[pieces.bytes[b]] for b in _utf8(char)) for char in self.characters]
        return np.where(self.piece >= 0, scores[self.piece], np.array(spelled)[np.maximum(-1 - self.piece, 0)])

    def forward(self, arcs):
        """Log of the summed weight of all ways to each place."""
        sums = np.zeros(self.last[-1] + 1)
        for low, high in self.depths:
            ends = self.end[low:high]
            ways = sums[self.start[low:high]] + arcs[low:high]
            groups = np.flatnonzero(np.diff(ends, prepend=-1))
            top = np.maximum.reduceat(ways, groups)
            sizes = np.diff(groups, append=len(ends))
            total = np.add.reduceat(np.exp(ways - np.repeat(top, sizes)), groups)
            sums[ends[groups]] = top + np.log(total)
        return sums


def _utf8(char):
    return chr(char).encode("utf-8", "surrogatepass")


_loaded = {}


def pieces_of(path=VOCABULARY):
    """One vocabulary per Python worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def log_probabilities(pieces, scores, words):
    """Natural log of the summed probability of all segmentations of each word."""
    if not words:
        return np.zeros(0)
    lattices = Lattices(pieces, words)
    return lattices.forward(lattices.arc_scores(pieces, scores))[lattices.last]


def add_expected(pieces, scores, words, times, counts):
    """Add the expected number of each piece in the segmentations of words that occur so many times."""
    if not words:
        return
    lattices = Lattices(pieces, words)
    arcs = lattices.arc_scores(pieces, scores)
    sums = lattices.forward(arcs)
    # From the end backwards: the share of all segmentations that pass each place, and each arc.
    passed = np.zeros(len(sums))
    passed[lattices.last] = times
    shares = np.exp(sums[lattices.start] + arcs - sums[lattices.end])
    for low, high in reversed(lattices.depths):
        shares[low:high] *= passed[lattices.end[low:high]]
        np.add.at(passed, lattices.start[low:high], shares[low:high])
    whole = lattices.piece >= 0
    counts += np.bincount(lattices.piece[whole], shares[whole], len(counts))
    spelled = np.bincount(-1 - lattices.piece[~whole], shares[~whole], len(lattices.characters))
    for char, share in zip(lattices.characters, spelled):
        for byte in _utf8(char):
            counts[pieces.bytes[byte]] += share


def is_held_out(doc_id):
    """Rows nothing is learned from; a missing id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(HELD_OUT_ONE_IN)) == 0


def _words(text):
    return text.encode("utf-8", "surrogatepass").translate(_LOWERED).split() if text else []


def _count_batches(batches):
    """Rows (word, n, n_train) of whole texts, counted together as far as memory allows."""
    counts, trained = Counter(), Counter()

    def counted():
        table = pa.record_batch(
            {
                "word": pa.array(list(counts), pa.binary()),
                "n": pa.array(counts.values(), pa.int64()),
                "n_train": pa.array([trained[word] for word in counts], pa.int64()),
            }
        )
        counts.clear()
        trained.clear()
        return table

    for batch in batches:
        for held_out, text in zip(*(column.to_pylist() for column in batch.columns)):
            words = _words(text)
            counts.update(words)
            if not held_out:
                trained.update(words)
            if len(counts) >= COUNTED:
                yield counted()
    yield counted()


def count_words(docs):
    """Every word of `docs` (held_out, text) with its occurrences in all and in training texts."""
    counted = docs.mapInArrow(_count_batches, "word binary, n bigint, n_train bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train"))


def _parts(words, *columns):
    """A batch in parts of a bounded number of bytes, or of single words beyond it."""
    start, size = 0, 0
    for place, word in enumerate(words):
        if size and size + len(word) > PART_BYTES:
            yield words[start:place], *(column[start:place] for column in columns)
            start, size = place, 0
        size += len(word) + 1
    yield words[start:], *(column[start:] for column in columns)


def expected_counts(words, scores, path):
    """Expected number of each piece in the training words; one row per piece reaches the driver."""

    def expect(batches):
        pieces = pieces_of(path)
        counts = np.zeros(len(pieces))
        for batch in batches:
            for words, times in _parts(*(column.to_pylist() for column in batch.columns)):
                add_expected(pieces, scores, words, times, counts)
        used = np.flatnonzero(counts)
        yield pa.record_batch({"piece": pa.array(used, pa.int32()), "n": pa.array(counts[used], pa.float64())})

    parts = words.filter("n_train > 0").select("word", "n_train").mapInArrow(expect, "piece int, n double")
    counts = np.zeros(len(scores))
    for row in parts.groupBy("piece").agg(F.sum("n").alias("n")).collect():
        counts[row.piece] = row.n
    return counts


def learn_scores(words, n_ends, path=VOCABULARY, rounds=ROUNDS, prior=PRIOR):
    """Natural log probabilities of the pieces and the end after `rounds` rounds over all training words."""
    pieces = pieces_of(path)
    scores = pieces.scores
    for _ in range(rounds):
        counts = expected_counts(words, scores, path)
        counts[pieces.end] = n_ends
        weights = counts + prior * np.exp(pieces.scores)
        scores = np.log(weights / weights.sum())
    return scores


def scored_words(words, scores, path):
    """The words with `log_p`, the natural log of the probability of each."""

    def scored(batches):
        pieces = pieces_of(path)
        for batch in batches:
            found = np.concatenate([log_probabilities(pieces, scores, words) for (words,) in _parts(batch.column(0).to_pylist())])
            yield pa.record_batch([*batch.columns, pa.array(found, pa.float64())], names=["word", "n", "n_train", "log_p"])

    return words.select("word", "n", "n_train").mapInArrow(scored, "word binary, n bigint, n_train bigint, log_p double")


def base_log10(train_tokens, distinct, count):
    """log10 of the share of a token that occurs `count` times in training."""
    return math.log10((count + ADDED) / (train_tokens + ADDED * (distinct + 1)))


_RARE = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))
_SUMMED = pa.schema(
    [
        ("row_id", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("base", pa.float64()), ("log_p", pa.float64()), ("rare", _RARE),
    ]
)
_SUMMED_DDL = (
    "row_id bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, log_p double, "
    "rare array<struct<word:binary,times:bigint>>"
)


def sum_frequent(rows, known, base_of):
    """Tokens and sums over the known words of each text; its other words are listed with their counts."""
    shared = rows.sparkSession.sparkContext.broadcast((known, base_of))

    def sums(batches):
        known, base_of = shared.value
        for batch in batches:
            summed = []
            for row_id, doc_id, held_out, text in zip(*(column.to_pylist() for column in batch.columns)):
                words = _words(text)
                n_known, base, log_p, rare = 0, 0.0, 0.0, []
                for word, times in Counter(words).items():
                    found = known.get(word)
                    if found is None:
                        rare.append((word, times))
                        continue
                    n_known += times if found[0] else 0
                    base += times * base_of(found[0])
                    log_p += times * found[1]
                summed.append((row_id, doc_id, held_out, len(words) + 1, n_known, base, log_p, rare))
            columns = zip(*summed) if summed else [()] * len(_SUMMED)
            yield pa.record_batch([pa.array(column, kind) for column, kind in zip(columns, _SUMMED.types)], schema=_SUMMED)

    return rows.mapInArrow(sums, _SUMMED_DDL)


def sum_rare(summed, words, total):
    """Rows (row_id, n_known, base, log_p): sums over the words that `summed` lists.

    Listed words of usual length are rare, so none is a hot key; longer ones may be and are salted.
    """
    listed = summed.select("row_id", F.explode("rare").alias("one")).select("row_id", "one.word", "one.times")
    words = words.select("word", "n_train", "log_p")
    long = F.octet_length("word") > KNOWN_BYTES
    found = listed.filter(~long).join(words.filter(~long), "word").unionByName(
        lookup_join(listed.filter(long), words.filter(long), "word")
    )
    base = F.log10((F.col("n_train") + ADDED) / total)
    return found.groupBy("row_id").agg(
        F.sum(F.when(F.col("n_train") > 0, F.col("times")).otherwise(F.lit(0))).alias("r_known"),
        F.sum(F.col("times") * base).alias("r_base"),
        F.sum(F.col("times") * F.col("log_p")).alias("r_log_p"),
    )


def score_documents(docs, path=VOCABULARY):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every document.

    `score` is the log10 probability of the text by the subword lattice, `base_score` that of the contract.
    A missing text is empty: one token, the end. A missing id counts as empty text where rows are held
    out. Repeated rows are scored and counted each. Without training rows all counts are 0 and the pieces
    keep the vocabulary's own scores. Extra columns are ignored; an empty table gives an empty result.
    """
    tables = run_tables(docs, "likelihood")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        is_held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    counted = tables.write(count_words(rows.select("held_out", "text")), "counted")
    n_ends = rows.filter(~F.col("held_out")).count()
    sums = counted.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count_if(F.col("n_train") > 0)).first()
    train_tokens, distinct = sums[0] + n_ends, sums[1] + (n_ends > 0)
    base_of = partial(base_log10, train_tokens, distinct)

    scores = learn_scores(counted, n_ends, path)
    words = tables.write(scored_words(counted, scores, path), "scored")
    # Number and length of these words bound what is sent to the tasks.
    short = words.filter(F.octet_length("word") <= KNOWN_BYTES)
    frequent = short.orderBy(F.desc("n"), "word").limit(KNOWN_WORDS).select("word", "n_train", "log_p").toArrow().to_pydict()
    known = dict(zip(frequent["word"], zip(frequent["n_train"], frequent["log_p"])))

    summed = tables.write(sum_frequent(rows, known, base_of), "summed")
    rare = sum_rare(summed, words, train_tokens + ADDED * (distinct + 1))
    end = float(scores[pieces_of(path).end])
    none = F.lit(0)
    return summed.drop("rare").join(rare, "row_id", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("r_known", none) + F.lit(int(n_ends > 0))).alias("n_known"),
        F.lit(train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("r_base", none) + F.lit(base_of(n_ends))).alias("base_score"),
        ((F.col("log_p") + F.coalesce("r_log_p", none) + F.lit(end)) / LOG10).alias("score"),
    )
