"""Token ids of whole texts by a public tokenizer, and of their pieces with a bounded cache."""

import base64
import os
import re
import struct

# Tasks run side by side already.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
# The same vocabulary as ranks, for the library that encodes whole texts fastest.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPECIAL = {"<|endoftext|>": 50256}

# The byte-level pre-tokenizer never joins anything across a blank that follows a non-blank, save that
# the blank belongs to what follows it. Only runs of three blanks, or two at the end, are cut otherwise.
_LONG_RUN = re.compile(r"\s\s(?:\s|\Z)")
_PIECES = re.compile(r"\s*\S+|\s+\Z")
_ENDED = re.compile(r"[A-Za-z][.,]\Z")
CACHE_ENTRIES = 1_200_000
CACHE_CHARS = 48


class PieceTokenizer(dict):
    """Maps a piece of text to its ids as little-endian unsigned 32-bit bytes.

    Pieces are words with the blank before them. Entries are dropped all at once when the cache is
    full, and long pieces are never kept, so memory is bounded.
    """

    def __init__(self, path=TOKENIZER):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        # A special token's name inside a text becomes that token, as in any call to the tokenizer.
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = {end: self.encode(end) for end in ",."}

    def __missing__(self, piece):
        if len(piece) > CACHE_CHARS:
            return self.encode(" " + piece)
        self.learn([piece])
        return self[piece]

    def learn(self, pieces):
        """Encode words in one call; a comma or full stop after a letter is a token of its own."""
        if len(self) + 2 * len(pieces) > CACHE_ENTRIES:
            self.clear()
        ended = [piece for piece in pieces if _ENDED.search(piece)]
        stems = {piece[:-1] for piece in ended}
        stems.update(piece for piece in pieces if not _ENDED.search(piece))
        new = [stem for stem in stems if stem not in self]
        coded = self.tokenizer.encode_batch_fast([" " + stem for stem in new], add_special_tokens=False)
        for stem, one in zip(new, coded):
            self[stem] = struct.pack(f"<{len(one.ids)}I", *one.ids)
        for piece in ended:
            self[piece] = self[piece[:-1]] + self.ends[piece[-1]]

    def encode(self, text):
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text):
        """Ids of a whole text, equal to those of one call to the tokenizer."""
        if not text:
            return b""
        if _LONG_RUN.search(text) or any(name in text for name in self.special):
            return self.encode(text)
        first, *rest = text.split(" ")
        unknown = [piece for piece in set(rest) if piece not in self and len(piece) <= CACHE_CHARS]
        if unknown:
            self.learn(unknown)
        return (self.encode(first) if first else b"") + b"".join(map(self.__getitem__, rest))

    def pieces(self, text):
        """Pieces whose ids do not depend on their neighbours: blanks and the word after them."""
        return _PIECES.findall(text)

    def count(self, piece):
        """Number of tokens of one piece from `pieces`."""
        if piece.startswith(" ") and not piece[1:2].isspace():
            return len(self[piece[1:]]) // 4
        return len(self.encode(piece)) // 4


class RankTokenizer:
    """Ids of whole texts, equal to those of a plain call to the tokenizer; keeps nothing between texts."""

    def __init__(self, path=RANKS, special=SPECIAL):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text):
        """Little-endian unsigned 32-bit ids; a special token's name inside a text becomes that token."""
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes() if text else b""


_loaded = {}


def text_tokenizer(path=RANKS):
    """One tokenizer of whole texts per Python worker."""
    if path not in _loaded:
        _loaded[path] = RankTokenizer(path)
    return _loaded[path]


def tokenizer_for(path=TOKENIZER):
    """One tokenizer with its cache per Python worker."""
    if path not in _loaded:
        _loaded[path] = PieceTokenizer(path)
    return _loaded[path]
