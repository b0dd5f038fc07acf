"""Evaluation texts leaking into training text: SimHash windows, multi-index Hamming blocks, exact verification.

A document holds an item if it has ``RUN`` or more consecutive words of it, or a stretch with at least ``STRETCH`` words
of the item in their order, of which at most one in ``EDITS`` is changed, left out or added.

1. Windows are as large as a part of an item can be that every leak must leave with one edit at most: ``WINDOW`` = 10
   words. (If each ten words of a stretch of n >= 25 had two edits, it would have 2 [n / 10] > n / 8.) An edit puts one
   word of a window out and another in. Each window gets a 64-bit SimHash over its words, weighted by how few items
   hold them, in ``BLOCKS`` blocks: a word votes on the bits of one block, which its hash names.
2. Multi-index Hamming blocks. An edit touches two blocks at most, the one of the word that goes and the one of the
   word that comes; so two windows one edit apart agree in all others, and looking up each choice of ``BLOCKS`` - 2
   blocks finds all fingerprints within that radius. No window within an edit of one of an item is missed.
3. Verification. A hit must have the words of its window but one in place; it then must leave room for a leak within
   ``BAND`` words of its diagonal. The pairs that remain are decided by the exact rule above, and each comes with its exact
   weighted similarity over shingles of ``SHINGLE`` words.

Items are a stated query set. They are taken in blocks of at most ``BLOCK_WORDS`` words, which bounds what a task
holds; all documents pass each block once, without a shuffle of any text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WORD, both_forms, mix, raw_words

WINDOW, BLOCKS, SHINGLE = 10, 4, 5
RUN, STRETCH, EDITS, BAND = 12, 25, 8, 6
BLOCK_WORDS = 2_000_000
CHUNK_WORDS = 150_000
TABLE_BITS = 20
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_BREAK = re.compile(r"[-‐‑][ \t]*\r?\n")
_HYPHEN = re.compile(r"(?<!\w)(\w++)[-‐‑][ \t]*\r?\n\s*(\w+)")


class Index:
    """A block of items, ready to be looked up by the windows of documents."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = [(i, WORD.findall(_INVISIBLE.sub("", t).lower())) for i, t in items]
        self.vocabulary: dict[str, int] = {}
        for _, w in texts:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary))
        self.unknown = len(self.vocabulary)
        self.forms = both_forms(self.vocabulary)
        self.ids = [i for i, _ in texts]
        self.words = np.array([self.vocabulary[x] for _, w in texts for x in w], np.int32)
        self.start = np.concatenate([[0], np.cumsum([len(w) for _, w in texts])]).astype(np.int64)
        held = Counter(x for _, w in texts for x in set(w))
        n = max(1, len(texts))
        # small integers: they are summed and compared only
        self.weight = np.array([1 + round(4 * math.log(n / held[x]) / max(1e-9, math.log(n))) if n > 1 else 1 for x in self.vocabulary] + [5], np.int16)
        hashed = np.array([xxhash.xxh64_intdigest(x) for x in self.vocabulary] + [0], np.uint64)
        size = 64 // BLOCKS
        bit = np.arange(64, dtype=np.uint64)
        votes = (hashed[:, None] % np.uint64(BLOCKS)) == bit // np.uint64(size)  # of one block each
        signs = ((mix(hashed)[:, None] >> bit) & np.uint64(1)).astype(np.int16) * 2 - 1
        self.signed = np.where(votes, signs * self.weight[:, None], 0).astype(np.int16)
        self.signed[self.unknown] = 0
        prints, self.at = self.prints(self.words, self.start)
        self.item = np.searchsorted(self.start, self.at, "right") - 1
        code, at = shingles(self.words, self.start)
        self.shingles: list[tuple[np.ndarray, np.ndarray]] = []
        owner = np.searchsorted(self.start, at, "right") - 1
        for k in range(len(texts)):
            mine = owner == k
            codes, first = np.unique(code[mine], return_index=True)
            self.shingles.append((codes, sum((self.weight[self.words[at[mine][first] + j]].astype(np.int64) for j in range(SHINGLE)), np.zeros(len(codes), np.int64))))
        self.tables = []
        for chosen in combinations(range(BLOCKS), BLOCKS - 2):
            mask = np.uint64(sum(((1 << size) - 1) << (size * c) for c in chosen))
            key = prints & mask
            order = np.argsort(key, kind="stable")
            seen = np.zeros(1 << TABLE_BITS, bool)
            seen[_table(key)] = True
            self.tables.append((mask, seen, key[order], order))

    def prints(self, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of all windows within texts, and where each window begins."""
        n = len(ids) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        text = np.searchsorted(start, np.arange(len(ids)), "right")
        inside = text[:n] == text[WINDOW - 1 :]
        # a window with more than one word that no item has isn't within an edit of any
        known = np.concatenate([[0], np.cumsum(ids != self.unknown)])
        at = np.flatnonzero(inside & (known[WINDOW:] - known[:-WINDOW] >= WINDOW - 1))
        out = np.zeros(len(at), np.uint64)
        for lo in range(0, len(at), CHUNK_WORDS):
            part = at[lo : lo + CHUNK_WORDS]
            total = self.signed[ids[part]]
            for k in range(1, WINDOW):
                total += self.signed[ids[part + k]]
            out[lo : lo + len(part)] = np.packbits(total > 0, axis=1, bitorder="little").view(np.uint64).ravel()
        return out, at

    def lookup(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (document window, item window) whose fingerprints differ in two blocks at most."""
        found = []
        for mask, seen, keys, order in self.tables:
            key = prints & mask
            some = np.flatnonzero(seen[_table(key)])
            lo, hi = np.searchsorted(keys, key[some], "left"), np.searchsorted(keys, key[some], "right")
            n = hi - lo
            mine = np.repeat(some, n)
            theirs = order[np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            found.append(mine.astype(np.int64) << 32 | theirs)
        both = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        both = both[np.flatnonzero(np.diff(both, prepend=-1))]
        return both >> 32, both & 0xFFFFFFFF

    def similarity(self, doc: np.ndarray, item: int) -> float:
        """The share of the item's weighted shingles that a text has."""
        codes, weight = self.shingles[item]
        return float(weight[np.isin(codes, doc)].sum() / max(1, weight.sum()))


def shingles(ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code of each run of ``SHINGLE`` words within texts, and where it begins."""
    n = max(0, len(ids) - SHINGLE + 1)
    text = np.searchsorted(start, np.arange(len(ids)), "right")
    at = np.flatnonzero(text[:n] == text[SHINGLE - 1 :][:n])
    code = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        code = mix(code * np.uint64(31) + ids[at + k].astype(np.uint64) + np.uint64(1))
    return code, at


def _table(key: np.ndarray) -> np.ndarray:
    return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _words(text: str, vocabulary: dict[str, int]) -> list:
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if _BREAK.search(text):
        # a word broken at a line end is one word, unless only its halves are words of an item
        text = _HYPHEN.sub(lambda m: m[1] + (" " if m[1] + m[2] not in vocabulary and m[1] in vocabulary and m[2] in vocabulary else "") + m[2], text.lower())
    return raw_words(text)


def holds(doc: np.ndarray, item: np.ndarray, p: int, q: int) -> bool:
    """Whether a stretch of the item around its word q, aligned to the document's word p, is in the document."""
    shifts = 2 * BAND + 1
    reach = 8 * EDITS
    i0, i1 = max(0, q - reach), min(len(item), q + WINDOW + reach)
    starts = i1 - i0
    # cost[s, d]: the least edits from the item's word i0 + s to the current one, ending on diagonal d
    big = 1 << 20
    cost = np.full((starts, shifts), big, np.int32)
    for i in range(i0, i1):
        s = i - i0
        cost[s] = 0  # a stretch may begin here, on any diagonal
        at = p + (i - q) + np.arange(-BAND, BAND + 1)
        inside = (at >= 0) & (at < len(doc))
        same = np.zeros(shifts, bool)
        same[inside] = doc[at[inside]] == item[i]
        now = cost[: s + 1]
        step = np.where(inside, now + ~same, big)  # kept or changed
        step[:, :-1] = np.minimum(step[:, :-1], now[:, 1:] + 1)  # left out of the document
        for d in range(1, shifts):  # added to the document
            step[:, d] = np.minimum(step[:, d], step[:, d - 1] + 1)
        cost[: s + 1] = step
        n = s + 1 - np.arange(s + 1)
        if s + 1 >= STRETCH and ((n >= STRETCH) & (step.min(1) * EDITS <= n)).any():
            return True
    return False


def scan(index: Index, texts: list[str]) -> list[tuple[int, int, float]]:
    """(position of the text, item id, similarity) of all items held by the texts; similarity is the share of the
    item's weighted shingles that the text has word for word."""
    split = [_words(t, index.vocabulary) if t else [] for t in texts]
    start = np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)
    flat = np.fromiter(map(index.forms.get, chain.from_iterable(split), repeat(index.unknown)), np.int32, int(start[-1]))
    prints, at = index.prints(flat, start)
    mine, theirs = index.lookup(prints)
    near = _one_edit(index, flat, at[mine], index.at[theirs])
    mine, theirs = mine[near], theirs[near]
    if not len(mine):
        return []
    p, q = at[mine], index.at[theirs]
    doc, item = np.searchsorted(start, p, "right") - 1, index.item[theirs]
    pair = doc * len(index.ids) + item
    # runs: windows that are equal, one after the other on a diagonal
    equal = np.ones(len(p), bool)
    for k in range(WINDOW):
        equal &= flat[p + k] == index.words[q + k]
    order = np.lexsort((p, p - q, pair))
    e = order[equal[order]]
    follows = np.zeros(len(e), bool)
    follows[1:] = (pair[e][1:] == pair[e][:-1]) & ((p - q)[e][1:] == (p - q)[e][:-1]) & (p[e][1:] == p[e][:-1] + 1)
    place = np.arange(len(e))
    length = place - np.maximum.accumulate(np.where(follows, 0, place)) + WINDOW
    found = set(np.unique(pair[e][length >= RUN]).tolist())
    # stretches: one hit of each pair and diagonal is enough for every RUN words
    rest = order[~np.isin(pair[order], np.fromiter(found, np.int64, len(found)))]
    if len(rest):
        key = np.stack([pair[rest], (p - q)[rest], q[rest] // RUN])
        rest = rest[np.unique(key, axis=1, return_index=True)[1]]
        for lo in range(0, len(rest), 20_000):
            part = rest[lo : lo + 20_000]
            part = part[_room(index, flat, start, p[part], q[part], doc[part], item[part])]
            for x in part:
                if int(pair[x]) in found:
                    continue
                d, i = doc[x], item[x]
                if holds(flat[start[d] : start[d + 1]], index.words[index.start[i] : index.start[i + 1]], int(p[x] - start[d]), int(q[x] - index.start[i])):
                    found.add(int(pair[x]))
    n = len(index.ids)
    out, held = [], {}
    for x in sorted(found):
        d, i = divmod(x, n)
        if d not in held:
            held[d] = shingles(flat[start[d] : start[d + 1]], np.array([0, start[d + 1] - start[d]]))[0]
        out.append((d, index.ids[i], index.similarity(held[d], i)))
    return out


def _one_edit(index: Index, flat: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether all words of the item's window but one stand in the text's window, at most one place off."""
    seen = np.zeros(len(p), np.int8)
    for k in range(WINDOW):
        want = index.words[q + k]
        hit = flat[p + k] == want
        if k:
            hit |= flat[p + k - 1] == want
        if k + 1 < WINDOW:
            hit |= flat[p + k + 1] == want
        seen += hit
    return seen >= WINDOW - 1


def _room(index: Index, flat, start, p, q, doc, item) -> np.ndarray:
    """Which hits may lie in a stretch that holds: of some STRETCH words of the item around the hit, each word counts
    as found if the document has it within BAND words of where it should be; the words found must reach what the
    permitted edits leave. An upper bound of what an alignment can find, so nothing is lost."""
    span = np.arange(-STRETCH + 1, WINDOW + STRETCH - 1)
    iq = q[:, None] + span
    inside = (iq >= index.start[item][:, None]) & (iq < index.start[item + 1][:, None])
    words = np.where(inside, index.words[np.clip(iq, 0, len(index.words) - 1)], -1)
    seen = np.zeros(words.shape, bool)
    for shift in range(-BAND, BAND + 1):
        dp = p[:, None] + span + shift
        ok = (dp >= start[doc][:, None]) & (dp < start[doc + 1][:, None])
        seen |= ok & (flat[np.clip(dp, 0, len(flat) - 1)] == words)
    sums = np.concatenate([np.zeros((len(p), 1), np.int32), np.cumsum(seen & inside, axis=1, dtype=np.int32)], axis=1)
    total = np.concatenate([np.zeros((len(p), 1), np.int32), np.cumsum(inside, axis=1, dtype=np.int32)], axis=1)
    got, of = sums[:, STRETCH:] - sums[:, :-STRETCH], total[:, STRETCH:] - total[:, :-STRETCH]
    # the best STRETCH words around the hit may have more edits than one in EDITS if a longer stretch makes up for it
    return ((of == STRETCH) & (got >= STRETCH - STRETCH // EDITS - 1)).any(1)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (doc_id, item_id, similarity), one for each document and item that it holds; similarity is the share of the
    item's weighted shingles of ``SHINGLE`` words that the document has word for word.

    Null and empty texts hold nothing and are held by none; items of fewer than RUN words are never held. Repeated
    documents each have their rows; an id that stands on several rows holds what any of them holds. Empty tables give
    no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    query = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    sizes = query.select(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(sizes / (5 * block_words)))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = []
    for b in range(blocks):
        held = [(r["item_id"], r["text"]) for r in query.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]
        if held:
            parts.append(source.mapInPandas(_scanner(spark.sparkContext.broadcast(held)), "doc_id long, item_id long, similarity double"))
    if not parts:
        return spark.createDataFrame([], "doc_id long, item_id long, similarity double")
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def _scanner(held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(held.value)
        for pdf in batches:
            ids, texts = pdf["doc_id"].to_numpy(), pdf["text"].tolist()
            for lo in range(0, len(ids), 2000):
                rows = scan(index, texts[lo : lo + 2000])
                yield pd.DataFrame({"doc_id": np.array([ids[lo + d] for d, _, _ in rows], np.int64), "item_id": np.array([i for _, i, _ in rows], np.int64), "similarity": np.array([s for _, _, s in rows], np.float64)})

    return run
