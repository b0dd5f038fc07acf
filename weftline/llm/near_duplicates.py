"""Near-duplicate records: fast similarity sketches, banding and exact verification.

Similarity is overlap of bags of words (``words.near_same``), so edits, insertions and another order all count.

1. Each text becomes its set of bag elements; texts with the same bag collapse to one representative. Only the key of
   the bag, its size and some parities leave this step, never the elements.
2. Elements are ordered by how many texts hold them, rarest first. The order comes from counts over all texts, kept in
   a table of fixed size (``COUNT_BITS``) that is small enough to broadcast at any input size; two elements that share
   a slot change only which elements are called rare. A text is sketched by the rarest ``RARE`` of its elements. If
   two texts share four fifths of the longer one, their rarest three quarters have a Jaccard similarity of 11/19 at
   least, and of 2/3 if what differs is spread evenly, while texts that share only everyday words share little of
   theirs.
3. The sketch is the fast similarity sketch: in round i each element falls into a random coordinate with the value
   i + a random fraction, and a coordinate keeps its least value; from round t on, round i serves coordinate i - t
   only. Each coordinate is filled after 2t rounds, all after about log t of a random kind, and the share of equal
   coordinates is concentrated around the Jaccard similarity.
4. ``BANDS`` bands of ``ROWS`` coordinates: texts that share a band are candidates. A pair is found with a probability
   of 0.99999 at 2/3 and 0.9998 at 11/19, the least possible; ``exact=True`` takes phrases (``phrases``) in place of
   bands, of which nearly same texts always share one, at a higher cost. Rows of (band, id) are shuffled once and sorted;
   runs of equal bands are streamed, and a run longer than ``RUN`` is handed on to a join that can be cut.
5. Sizes and then parities drop candidates that can't be near: each element flips one of ``BITS`` or more bits, four
   for each element at least, and two bags differ in as many elements as bits at least. Bits of a longer row fold onto
   those of a shorter one. Every other candidate pair is compared exactly. Neither loses a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import hash_to_min
from .phrases import phrases, rarity
from .words import NEAR, Hashes, bag_elements, bag_key, mix, raw_words, words

BANDS, ROWS, RARE = 128, 5, 0.75
BITS, RUN, PHRASE = 256, 64, 4
COUNT_BITS = 18


def sketch(elements: list[np.ndarray], t: int) -> np.ndarray:
    """The fast similarity sketches of sets of 64-bit elements, one row of t values for each; a set may not be empty."""
    n = len(elements)
    flat = np.concatenate(elements).astype(np.uint64)
    row = np.repeat(np.arange(n), [len(e) for e in elements])
    out = np.full(n * t, np.uint64(0xFFFFFFFFFFFFFFFF))
    open_ = np.arange(n)  # sets with coordinates to fill
    for i in range(2 * t):
        h = mix(flat + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        slot = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(h), i - t)
        at = row * t + slot
        empty = out[at] >> np.uint64(32) >= np.uint64(i)  # earlier rounds have lower values
        at, value = at[empty], (np.uint64(i) << np.uint64(32)) | (h[empty] & np.uint64(0xFFFFFFFF))
        np.minimum.at(out, at, value)
        some = (out.reshape(n, t)[open_] == np.uint64(0xFFFFFFFFFFFFFFFF)).any(1)
        if not some.all():
            open_ = open_[some]
            if not len(open_):
                break
            free = np.zeros(n, bool)
            free[open_] = True
            live = free[row]
            flat, row = flat[live], row[live]
    return out.reshape(n, t)


def _elements(text: str | None, hashes: Hashes) -> np.ndarray | None:
    w = raw_words(text)
    return bag_elements(np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))) if w else None


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each text with words, and after them, with n = -1, how many of a task's elements fall on each slot
    (k1, k2): one pass serves both."""
    hashes, total = Hashes(), np.zeros(1 << COUNT_BITS, np.int64)
    for pdf in batches:
        rows, found = [], []
        for i, text in zip(pdf["id"], pdf["text"]):
            e = _elements(text, hashes)
            if e is not None:
                rows.append((i, *bag_key(e), len(e), parity(e)))
                found.append(e)
        if found:
            total += np.bincount(_slot(np.concatenate(found)), minlength=1 << COUNT_BITS)
        yield pd.DataFrame(rows, columns=["id", "k1", "k2", "n", "bits"])
    used = np.flatnonzero(total)
    yield pd.DataFrame({"id": 0, "k1": used, "k2": total[used], "n": -1, "bits": None})


def _slot(elements: np.ndarray) -> np.ndarray:
    return (elements.view(np.uint64) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def rarest(elements: np.ndarray, counts: np.ndarray, rare: float = RARE) -> np.ndarray:
    """The rarest share of a text's elements in the order (count, element), which is the same for all texts."""
    e = elements.view(np.uint64)
    return e[np.lexsort((e, counts[_slot(elements)]))][: max(1, int(np.ceil(rare * len(e))))]


def parity(elements: np.ndarray) -> np.ndarray:
    """As longs, a power of two of bits, ``BITS`` and four for each element at least: whether an odd number of elements
    falls on each."""
    bits = max(BITS, 1 << (4 * len(elements) - 1).bit_length())
    odd = np.bincount((elements.view(np.uint64) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _differ(x: Column, y: Column) -> Column:
    """In how many bits two parities differ, the longer folded to half if their lengths do."""
    half = lambda v: F.zip_with(F.slice(v, F.lit(1), (F.size(v) / 2).cast("int")), F.slice(v, (F.size(v) / 2).cast("int") + 1, (F.size(v) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    same = lambda v, w: F.when(F.size(v) > F.size(w), half(v)).otherwise(v)
    return F.aggregate(F.zip_with(same(x, y), same(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, d: n + d)


def _bands(counts_broadcast, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, hashes = counts_broadcast.value, Hashes()
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                s = sketch([rarest(_elements(t, hashes), counts) for t in part["text"]], bands * rows)
                keys = np.zeros((len(part), bands), np.uint64)
                for r in range(rows):
                    keys = mix(keys * np.uint64(31) + s[:, r::rows][:, :bands] + np.arange(bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))  # bands have keys of their own
                yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), bands), "key": keys.view(np.int64).ravel()})

    return run


def _phrases(counts_broadcast, share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, hashes = counts_broadcast.value, Hashes()
        for pdf in batches:
            found = [phrases(words(t), counts, hashes, PHRASE, share) for t in pdf["text"]]
            n = np.fromiter(map(len, found), np.int64, len(found))
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), n), "key": np.fromiter((x for f in found for x in f), np.int64, int(n.sum()))})

    return run


def _meet(longest: int):
    """Rows (id, key) sorted by key -> (a, b, key): pairs of ids with the same key; of keys with more than ``longest``
    ids the rows themselves, as a with its key and no b."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_key, held, hot = None, np.zeros(0, np.int64), False  # the run that may go on in the next batch
        for pdf in batches:
            key, ids = pdf["key"].to_numpy(), pdf["id"].to_numpy()
            if not len(key):
                continue
            a, b, k = [], [], []
            if held_key is not None and key[0] == held_key:
                if not hot:
                    key, ids = np.concatenate([np.full(len(held), held_key), key]), np.concatenate([held, ids])
            else:
                hot = False
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(begin, len(key)))
            long = size > longest
            long[0] |= hot  # the rest of a run whose first part has gone out
            if not hot and held_key is not None and key[0] == held_key:
                done = len(held)  # pairs among these are out already
            else:
                done = 0
            rows = np.repeat(long, size)
            a.append(ids[rows])
            b.append(np.full(int(rows.sum()), -1, np.int64))
            k.append(key[rows])
            short = ~rows
            sk, si = key[short], ids[short]
            old = np.zeros(len(key), bool)
            old[:done] = True
            so = old[short]
            for lag in range(1, longest):
                equal = sk[lag:] == sk[:-lag]
                if not equal.any():
                    break
                same = np.flatnonzero(equal & ~so[lag:])
                a.append(np.minimum(si[same], si[same + lag]))
                b.append(np.maximum(si[same], si[same + lag]))
                k.append(np.zeros(len(same), np.int64))
            held_key, hot = key[-1], bool(long[-1])
            held = np.zeros(0, np.int64) if hot else ids[begin[-1] :]
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "key": np.concatenate(k)})

    return run


def representatives(df: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame, DataFrame, np.ndarray]:
    """(id, rep) for each row with words, (id, n, bits) for each representative, the least id of its bag, (id, text) of
    these, and how many elements fall on each slot: a table of fixed size, 2 MB, however large the input."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).where("id is not null and text is not null")
    schema = "id long, k1 long, k2 long, n int, bits array<long>"
    bags = materialize(rows.mapInPandas(_bags, schema), "bags")
    n = bags.where("n > 0").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).first()
    if n["n"] > n["ids"]:  # of a repeated id the text of least hash counts
        rows = materialize(rows.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "rows")
        bags = materialize(rows.mapInPandas(_bags, schema), "bags")
    counted = bags.where("n < 0").groupBy("k1").agg(F.sum("k2").alias("n")).toPandas()
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    counts[counted["k1"]] = counted["n"]
    bags = bags.where("n > 0")
    least = bags.groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    members = materialize(bags.select("id", "k1", "k2").join(least, ["k1", "k2"]).select("id", "rep"), "members")
    own = members.where("id = rep").select("id")
    return members, bags.drop("k1", "k2").join(own, "id", "left_semi"), rows.join(own, "id", "left_semi"), counts


def candidate_pairs(signs: DataFrame, texts: DataFrame, counts: np.ndarray, share: float = NEAR, bands: int = BANDS, rows: int = ROWS, exact: bool = False) -> DataFrame:
    """Distinct pairs (a, b), a < b, of representatives that share a band, or a phrase if ``exact``, and may be nearly
    the same by their sizes and parities."""
    sc = texts.sparkSession.sparkContext
    if exact:
        keyed = texts.mapInPandas(_phrases(sc.broadcast(rarity(texts)), share), "id long, key long")
    else:
        keyed = texts.mapInPandas(_bands(sc.broadcast(counts), bands, rows), "id long, key long")
    met = materialize(keyed.repartition("key").sortWithinPartitions("key").mapInPandas(_meet(RUN), "a long, b long, key long"), "met")
    hot = met.where("b < 0").select(F.col("a").alias("id"), "key").distinct()
    more = hot.select("key", F.col("id").alias("a")).join(hot.select("key", F.col("id").alias("b")), "key").where("a < b")
    pairs = met.where("b >= 0 and a < b").select("a", "b").union(more.select("a", "b")).distinct()
    for column in ("n", "bits"):
        for side in "ab":
            pairs = pairs.join(signs.select(F.col("id").alias(side), F.col(column).alias(f"{column}_{side}")), side)
        long = F.greatest("n_a", "n_b")
        if column == "n":
            pairs = pairs.where(F.least("n_a", "n_b") >= share * long - 1e-9)
    return pairs.where(_differ(F.col("bits_a"), F.col("bits_b")) <= F.col("n_a") + F.col("n_b") - 2 * F.ceil(F.lit(share) * long - 1e-9)).select("a", "b")


def _verify(share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for pdf in batches:
            bags: dict[int, set[int]] = {}
            rows = []
            for a, b, x, y in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["x"], pdf["y"]):
                for i, t in ((a, x), (b, y)):
                    if i not in bags:
                        bags[i] = set(_elements(t, hashes).tolist())
                longer = max(len(bags[a]), len(bags[b]))
                common = len(bags[a] & bags[b])
                if common >= share * longer - 1e-9:
                    rows.append((a, b, common / longer))
            yield pd.DataFrame(rows, columns=["a", "b", "overlap"])

    return run


def similar_pairs(signs: DataFrame, texts: DataFrame, counts: np.ndarray, share: float = NEAR, exact: bool = False) -> DataFrame:
    """Pairs (a, b, overlap) of representatives whose bags are nearly the same; overlap is of the larger bag."""
    pairs = materialize(candidate_pairs(signs, texts, counts, share, exact=exact), "candidates")
    met = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInPandas(_verify(share), "a long, b long, overlap double")


def near_duplicate_pairs(df: DataFrame, id_column: str, text_column: str, share: float = NEAR, exact: bool = False) -> DataFrame:
    """Rows (id_a, id_b), id_a < id_b, of all rows whose texts are nearly the same or equal as bags of words.

    Null and blank texts, and those without any letter or digit, make no pair. Of rows that repeat an id
    one counts, that of the text with the least hash. An empty table gives no rows. Other columns are ignored. Copies are expanded into pairs;
    ``near_duplicate_groups`` doesn't. Runs jobs when called.
    """
    members, signs, texts, counts = representatives(df, id_column, text_column)
    links = materialize(similar_pairs(signs, texts, counts, share, exact).select("a", "b"), "links")
    # a representative is linked with itself, which pairs its copies
    own = members.groupBy("rep").count().where("count > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    both = links.union(own)
    out = both.join(members.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b")
    return out.where("a != b or x < y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicate_groups(df: DataFrame, id_column: str, text_column: str, share: float = NEAR, exact: bool = False) -> DataFrame:
    """One row (id, rep, group_id, copies, links) for each row with words.

    rep is the least id with an equal bag, copies how many rows share that bag, links to how many other bags the bag
    is nearly the same, and group_id the least id that is connected by equal bags and links. Same cases as
    ``near_duplicate_pairs``; a row without words belongs to no group and has no row here.
    """
    members, signs, texts, counts = representatives(df, id_column, text_column)
    links = materialize(similar_pairs(signs, texts, counts, share, exact).select("a", "b"), "links")
    degree = links.select("a").union(links.select("b")).toDF("rep").groupBy("rep").agg(F.count("*").alias("links"))
    group = hash_to_min(links).toDF("rep", "group_id")
    copies = members.groupBy("rep").agg(F.count("*").alias("copies"))
    out = members.join(copies, "rep").join(degree, "rep", "left").join(group, "rep", "left")
    return out.select("id", "rep", F.coalesce("group_id", "rep").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
