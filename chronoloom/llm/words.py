"""Vectorised word and shingle hashing over the UTF-8 bytes of a block of texts.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z count as a-z.  Both only
concern ASCII bytes, so working on UTF-8 bytes gives the same words as working on characters.

A word's hash is the finalised sum of its mixed 8-byte blocks, each keyed by its place, so no regular
pair of words (of any length) collides as under a polynomial; among n different words about n^2 / 2^65
pairs share a hash by chance.
"""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_KEY = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that all bits of the result are usable."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lowered(raw: bytes) -> bytes:
    """A-Z as a-z."""
    return raw.translate(_LOWER.tobytes())


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows in order, and where each row's words begin."""
    rows = len(offsets) - 1
    if len(data) == 0:
        return np.empty(0, np.uint64), np.zeros(rows + 1, np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = solid[heads]
    starts = np.flatnonzero(first)
    pointers = np.searchsorted(starts, offsets)
    if len(starts) == 0:
        return np.empty(0, np.uint64), pointers
    letters = _LOWER[data[solid]]
    begin = np.flatnonzero(first[solid])
    length = np.diff(np.append(begin, len(letters)))
    place = np.arange(len(letters)) - np.repeat(begin, length)
    within = (place & 7).astype(np.uint8)
    heads = np.flatnonzero(within == 0)  # of blocks of 8 letters
    blocks = np.bitwise_or.reduceat(letters.astype(np.uint64) << (within.astype(np.uint64) << np.uint64(3)), heads)
    turn = place[heads] >> 3
    keyed = mix(blocks ^ mix((turn.astype(np.uint64) + np.uint64(1)) * _KEY))
    hashed = np.add.reduceat(keyed, np.flatnonzero(turn == 0))
    return mix(hashed ^ (length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), pointers


def shingle_hashes(words: np.ndarray, pointers: np.ndarray, k: int) -> list[np.ndarray]:
    """The distinct k-word shingles of each row, sorted by hash; a shorter row is one shingle."""
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i, f in enumerate(factors):
            rolled += words[i : i + len(rolled)] * f
        rolled = mix(rolled)
        out = []
        for a, b in zip(pointers[:-1].tolist(), pointers[1:].tolist(), strict=True):
            n = b - a
            if n >= k:
                s = np.sort(rolled[a : b - k + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
            elif n:
                short = words[a:b] * factors[:n]
                out.append(mix(short.sum(keepdims=True) ^ np.uint64(0x589965CC75374CC3 + n)))
            else:
                out.append(np.empty(0, np.uint64))
    return out
