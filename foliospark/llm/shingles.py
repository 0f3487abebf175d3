"""Words and word shingles as 64-bit numbers, computed with numpy over whole Arrow buffers.

A word is a run of bytes other than space, tab, newline, vertical tab, form feed and carriage
return, with A-Z in lower case. Its hash is a polynomial over its bytes modulo 2**64, taken from
prefix sums, so that no Python code runs for single words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240607)
#: A random odd number for each byte; A-Z have the numbers of a-z.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]
#: The same with A-Z apart.
RAW_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
#: For a second hash, beside RAW_BYTE.
CHECK_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: White space and ASCII punctuation.
SEPARATORS = _SPACE.copy()
SEPARATORS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
#: Texts are gathered into pieces of about so many bytes; a longer text is a piece by itself.
PIECE_BYTES = 1 << 18
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 2 * PIECE_BYTES)
        have = np.full(size, U(_BASE if kind == "up" else _BASE_INVERSE))
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size > 1 << 22:  # a very long text; do not keep its table
            return have
        _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte: np.ndarray = _BYTE) -> np.ndarray:
    """Hashes of data[start:end] for each pair."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte[data] * _power("up", len(data)), dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def pieces(texts: pa.Array, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets of the texts in them) for runs of texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + piece_bytes, "right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray, blank_bytes: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of words before it."""
    blank = blank_bytes[data]
    edge = np.zeros(len(data) + 1, bool)  # a text begins here
    edge[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = blank[:-1]
    starts = np.flatnonzero(~blank & (before | edge[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = blank[1:]
    ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_rows(words: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of k words; with fewer words, one for the whole sequence; with none, none."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        total = np.array([n], np.uint64)
        for i in range(n):
            total = mix(total * U(0xD6E8FEB86659FD93) + words[i : i + 1])
        return total
    total = words[: n - k + 1] * U(0xD6E8FEB86659FD93)
    for i in range(1, k):
        total = (total ^ (total >> U(29))) * U(0xD6E8FEB86659FD93) + words[i : n - k + 1 + i]
    return mix(total)


def text_words(texts: pa.Array, blank_bytes: np.ndarray = _SPACE) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order."""
    for _, data, offsets in pieces(texts):
        starts, ends, at = word_bounds(data, offsets, blank_bytes)
        words = span_hashes(data, starts, ends)
        for i in range(len(offsets) - 1):
            yield words[at[i] : at[i + 1]]


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for words in text_words(texts):
        yield np.unique(shingle_rows(words, k))
