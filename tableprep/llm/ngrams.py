"""Hashed n-grams of whole texts in numpy, block by block."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Code points worked on at once; blocks overlap by the longest n-gram less one.
BLOCK = 1 << 20
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x9E3779F9], np.uint32)


@lru_cache(1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def blocks(text: str, overlap: int) -> Iterator[np.ndarray]:
    """The code points of a text, in blocks."""
    for at in range(0, max(len(text), 1), BLOCK):
        yield np.frombuffer(text[at:at + BLOCK + overlap].encode("utf-32-le", "surrogatepass"), "<u4")


def grams(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of every n-gram of one order."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, order, np.uint32)
    for k in range(order):
        h = (h ^ codes[k:k + n].astype(np.uint32)) * _PRIMES[k]
        h ^= h >> np.uint32(15)
    return (h * _PRIMES[5] >> np.uint32(32 - bits)).astype(np.int64)


def word_hashes(codes: np.ndarray) -> np.ndarray:
    """64-bit hash of every word: a run of code points that are no white space (space and 9 to 13)."""
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    inside = np.flatnonzero(~space)
    if not len(inside):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.r_[True, np.diff(inside) > 1])
    place = np.arange(len(inside)) - np.repeat(first, np.diff(np.r_[first, len(inside)]))
    factor = np.uint64(0x9E3779B97F4A7C15) * (2 * place.astype(np.uint64) + np.uint64(1))
    mixed = (codes[inside].astype(np.uint64) + np.uint64(1)) * factor
    h = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), first) * np.uint64(0xBF58476D1CE4E5B9)
    return h


def top(h: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of 64-bit hashes."""
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def neighbours(h: np.ndarray) -> np.ndarray:
    """Hash of every two words in a row; a word that is repeated at once is one and the same feature for all words."""
    pair = (h[:-1] ^ (h[1:] >> np.uint64(7))) * np.uint64(0x94D049BB133111EB)
    return np.where(h[:-1] == h[1:], np.uint64(0xD1B54A32D192ED03), pair ^ (pair >> np.uint64(31)))
