"""Hashes of words and word shingles of a text, computed for all of them at once."""

import numpy as np


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x):
    """SplitMix64 finaliser: spreads every input bit over the output."""
    x = np.asarray(x, np.uint64).copy()
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BYTE_CODES = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x5EED))
_powers = {"n": 0}


def _powers_to(n):
    """Powers of the base and of its inverse modulo 2**64."""
    if _powers["n"] < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                row = np.full(size, base, np.uint64)
                row[0] = 1
                _powers[name] = np.multiply.accumulate(row)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def normalised(text):
    """Lower-cased (A-Z only) words of the text joined by single blanks, as bytes."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    return b" ".join(data.translate(_LOWERED).split())


def word_bounds(data):
    """(starts, ends) of the words of normalised bytes."""
    codes = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero(codes == 32)
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(codes)]])


def span_hashes(data, starts, ends):
    """64-bit hash of data[start:end] for each pair, from one pass over the bytes."""
    up, down = _powers_to(len(data) + 1)
    with np.errstate(over="ignore"):
        terms = _BYTE_CODES[np.frombuffer(data, np.uint8)] * up[: len(data)]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        value = (sums[ends] - sums[starts]) * down[starts]
    return mix(value ^ (ends - starts).astype(np.uint64))


def shingle_hashes(data, words=3):
    """Hash of each run of `words` words in order; fewer words make one shingle, none make none."""
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.empty(0, np.uint64)
    if len(starts) < words:
        return span_hashes(data, starts[:1], ends[-1:])
    return span_hashes(data, starts[: len(starts) - words + 1], ends[words - 1 :])


def signed(values):
    """The same 64 bits as Spark's bigint."""
    return values.view(np.int64)


