"""Words, bags of words and hashes that the operators here share.

A word is a longest run of letters or digits, letter case ignored. Two texts are nearly the same if at least
``share`` of the words of the longer one, each occurrence counted, also occur in the other.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
NEAR = 0.8
_M = np.uint64(0xFFFFFFFFFFFFFFFF)


#: Latin-1 bytes: letters and digits in lower case, all else a blank.
LATIN = bytes(ord(c.lower()) if c.isalnum() and len(c.lower()) == 1 and ord(c.lower()) < 256 else 32 for c in map(chr, range(256)))


def words(text: str | None) -> list[str]:
    if not text:
        return []
    try:  # the same words, several times faster
        return text.encode("latin-1").translate(LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORD.findall(text.lower())


def raw_words(text: str | None) -> list:
    """The words of a text, as Latin-1 bytes where the whole text has that form, which is several times faster to
    find, else as strings. Dictionaries of words hold both forms of each (``both_forms``)."""
    if not text:
        return []
    try:
        return text.encode("latin-1").translate(LATIN).split()
    except UnicodeEncodeError:
        return WORD.findall(text.lower())


def both_forms(vocabulary: dict[str, int]) -> dict:
    """word -> id, with the Latin-1 form of each word beside it."""
    out: dict = dict(vocabulary)
    for w, i in vocabulary.items():
        try:
            out[w.encode("latin-1")] = i
        except UnicodeEncodeError:
            pass
    return out


def near_same(a: list[str], b: list[str], share: float = NEAR) -> bool:
    """Whether two lists of words are nearly the same; a text without words is nearly the same as none."""
    if not a or not b:
        return False
    need = share * max(len(a), len(b)) - 1e-9
    if min(len(a), len(b)) < need:
        return False
    left = Counter(a)
    return sum(min(n, left[w]) for w, n in Counter(b).items() if w in left) >= need


def prefix_length(n: int, share: float = NEAR) -> int:
    """How many of n words, in any order common to all texts, must hold one of each nearly same text."""
    return n - math.ceil(share * n - 1e-9) + 1


class Hashes(dict):
    """word, in either form of ``raw_words``, -> 64-bit hash, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.decode("latin-1") if isinstance(word, bytes) else word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 arrays."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def bag_elements(hashed: np.ndarray) -> np.ndarray:
    """Of a text's word hashes, one distinct element for each occurrence, sorted: the k-th occurrence of a word
    is another element than the first, so set overlap of elements is overlap of bags."""
    s = np.sort(hashed)
    n = len(s)
    if n == 0:
        return s
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    k = (np.arange(n) - start).astype(np.uint64)
    return np.sort(mix(s + k * np.uint64(0x9E3779B97F4A7C15)))


def bag_key(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that name a bag: equal bags have equal keys, others almost never."""
    b = elements.tobytes()
    return xxhash.xxh64_intdigest(b, 1) - (1 << 63), xxhash.xxh64_intdigest(b, 2) - (1 << 63)
