"""Words and word shingles of many texts as 64-bit numbers.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, with A-Z in
lower case. A word's number is a hash of its bytes and length, a shingle's one of its words in order. Two different
words or shingles share a number with a chance of about 2**-57.
"""

from __future__ import annotations

import numpy as np
import xxhash

from tidewell.llm.common import mixed

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LONGEST = 64  # bytes of a word that are hashed together with others; longer words are hashed one by one
FACTORS = np.random.default_rng(97).integers(1, 2**64, LONGEST, np.uint64, endpoint=False) | np.uint64(1)
MULTIPLIER = np.uint64(0x9FB21C651E98DF25)


def word_numbers(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the first word of each row (one more than rows), and each word's first and last byte."""
    data = LOWER[data]
    inside = ~SPACES[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = np.zeros(len(data) + 1, bool)
    begins[rows] = True
    first |= inside & begins[:-1]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begins[1:-1]
    ends = np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64), starts, ends
    number = np.cumsum(first) - 1  # of the word at each byte; spaces follow the word before them
    place = np.arange(len(data)) - starts[np.maximum(number, 0)]
    with np.errstate(over="ignore"):
        terms = (data.astype(np.uint64) + np.uint64(1)) * FACTORS[np.minimum(place, LONGEST - 1)]
        terms[~inside] = 0
        hashes = mixed(np.add.reduceat(terms, starts) + (ends - starts).astype(np.uint64) * MULTIPLIER)
    for i in np.flatnonzero(ends - starts > LONGEST):
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return hashes, np.searchsorted(starts, rows), starts, ends


def shingle_numbers(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words; runs may cross rows, which callers leave out."""
    n = max(len(words) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * MULTIPLIER + words[i : i + n]
            out ^= out >> np.uint64(29)
    return mixed(out)
