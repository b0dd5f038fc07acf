"""Phrases that nearly same texts must share, whatever the order of their words.

A text is normalised to its words from rare to common, each occurrence a word of its own. If two texts share four
fifths of the longer one, at most d of a text's words are missing in the other. The first d + (k - 1) m + 1 words in
that order are thrown into m cells by a hash, and each k words of a cell are a phrase. Of those words (k - 1) m + 1 at
least stand in both texts, so some cell holds k of them and the phrase of these k stands in both: no pair is lost.
Phrases of several rare words are shared by hardly anything else, unlike single words.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import NEAR, Hashes, words

COUNT_BITS = 18
_M = 0xFFFFFFFFFFFFFFFF


def slot(h: int) -> int:
    return h >> (64 - COUNT_BITS)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes, total = Hashes(), np.zeros(1 << COUNT_BITS, np.int64)
    for pdf in batches:
        for t in pdf["text"]:
            s = {slot(hashes[w]) for w in words(t)}
            if s:
                total[list(s)] += 1
    used = np.flatnonzero(total)
    yield pd.DataFrame({"slot": used.astype(np.int32), "n": total[used]})


def rarity(texts: DataFrame) -> np.ndarray:
    """In how many of the texts (column text) the words of each slot stand: an array of fixed size, however large the
    input. Words that share a slot change only which words are called rare. Runs a job over all texts."""
    counted = texts.select("text").mapInPandas(_count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    counts[counted["slot"]] = counted["n"]
    return counts


def shape(n: int, share: float, phrase: int) -> tuple[int, int]:
    """(cells, words of a phrase) for a pair of texts of which the longer has n words."""
    need = math.ceil(share * n - 1e-9)
    k = min(phrase, need)
    m = 1 << max(0, math.ceil(math.log2(max(1, (n - need) / 4))))
    return (m, k) if (k - 1) * m + 1 <= need else (1, k)


def phrases(w: list[str], counts: np.ndarray, hashes: Hashes, phrase: int, share: float = NEAR) -> list[int]:
    """The phrases of a text, as signed 64-bit hashes, for every length that a longer text nearly the same may have."""
    if not w:
        return []
    seen: Counter = Counter()
    order = []
    for x in w:
        h = hashes[x]
        order.append((int(counts[h >> (64 - COUNT_BITS)]), h, seen[h]))
        seen[h] += 1
    order.sort()
    ids = [(h + k * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & _M for _, h, k in order]
    n = len(ids)
    missing = n - math.ceil(share * n - 1e-9)
    out: set[int] = set()
    for m, k in {shape(x, share, phrase) for x in range(n, math.floor(n / share + 1e-9) + 1)}:
        first = ids[: min(n, missing + (k - 1) * m + 1)]
        if m == 1:
            cells = [first]
        else:
            by: dict[int, list[int]] = defaultdict(list)
            for e in first:
                by[(e >> 32) % m].append(e)
            cells = list(by.values())
        for cell in cells:
            out.update(hash((m, *c)) for c in combinations(sorted(cell), k))
    return list(out)
