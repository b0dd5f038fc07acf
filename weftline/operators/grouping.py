"""Greedy packing with open bins, and grouping of contexts by length."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chat import CHAT_OVERHEAD
from .relations import ranked, seeded

OPEN_BINS = 100
#: Items that a task packs where the number of shards isn't given.
SHARD_ITEMS = 1_000_000


def first_fit(costs: list[int], budget: int, open_bins: int = OPEN_BINS) -> list[list[int]]:
    """Groups of positions in the order in which they close.

    A cost over the budget is a group of its own at once. Others go to the first open bin with room; without any, the
    bin with the least room, the first of equals, closes and begins again with the item. At the end the open bins close
    in their order. A segment tree over the room of the bins finds the first that fits and the fullest in logarithmic
    time.
    """
    size = 1
    while size < open_bins:
        size *= 2
    most = [-1] * (2 * size)
    least = [budget + 1] * (2 * size)
    held: list[list[int]] = [[] for _ in range(open_bins)]

    def put(b: int, room: int) -> None:
        k = size + b
        most[k] = least[k] = room
        k //= 2
        while k:
            most[k] = max(most[2 * k], most[2 * k + 1])
            least[k] = min(least[2 * k], least[2 * k + 1])
            k //= 2

    for b in range(open_bins):
        put(b, budget)
    out: list[list[int]] = []
    for i, cost in enumerate(costs):
        if cost > budget:
            out.append([i])
            continue
        k = 1
        if most[1] >= cost:
            while k < size:
                k = 2 * k if most[2 * k] >= cost else 2 * k + 1
            held[k - size].append(i)
            put(k - size, most[k] - cost)
        else:
            while k < size:
                k = 2 * k if least[2 * k] <= least[2 * k + 1] else 2 * k + 1
            b = k - size
            if held[b]:
                out.append(held[b])
            held[b] = [i]
            put(b, budget - cost)
    return out + [b for b in held if b]


def greedy_pack(df: DataFrame, pos: str, tokens: Column, budget: int, shards: int | None = None, open_bins: int = OPEN_BINS, overhead: int = CHAT_OVERHEAD) -> DataFrame:
    """(shard, bin, slot, pos, cost) of items in the order of ``pos``, each costing its tokens and the overhead.

    The result depends on the whole order, so one shard packs all in one task, as a single reader would; a task holds
    its shard in memory, some 200 bytes an item. Without a number there are as many shards as ``SHARD_ITEMS`` items
    ask for, which takes a count of the rows; each shard of positions (by hash) is packed by itself, which leaves at
    most ``open_bins`` part-filled bins more for each. Null lengths count as 0, null positions are left out.
    """
    if shards is None:
        shards = max(1, -(-df.where(F.col(pos).isNotNull()).count() // SHARD_ITEMS))
    shard = F.pmod(F.xxhash64(F.col(pos)), F.lit(shards)).cast("int")
    rows = df.select(shard.alias("shard"), F.col(pos).cast("long").alias("pos"), (F.coalesce(tokens, F.lit(0)) + overhead).cast("int").alias("cost")).where("pos is not null")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        where = [(b, s, i) for b, group in enumerate(first_fit(pdf["cost"].tolist(), budget, open_bins)) for s, i in enumerate(group)]
        picked = pdf.iloc[[i for _, _, i in where]]
        return pd.DataFrame({"shard": picked["shard"].to_numpy(), "bin": [b for b, _, _ in where], "slot": [s for _, s, _ in where], "pos": picked["pos"].to_numpy(), "cost": picked["cost"].to_numpy()})

    return rows.groupBy("shard").applyInPandas(pack, "shard int, bin int, slot int, pos long, cost int")


def bin_texts(bins: DataFrame, texts: DataFrame, pos: str, text: str) -> DataFrame:
    """(shard, bin, texts): the texts of each bin in the order of their slots."""
    j = bins.join(texts.select(F.col(pos).alias("pos"), F.col(text).alias("t")), "pos")
    return j.groupBy("shard", "bin").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "t"))), lambda x: x["t"]).alias("texts"))


def without_members(bins: DataFrame, leave: DataFrame, pos: str) -> DataFrame:
    """Bins without the listed positions; bins that lose all are gone."""
    return bins.join(leave.select(pos).distinct(), pos, "left_anti")


def random_groups(df: DataFrame, key: str, tokens: Column, length: int, seed: int = 0) -> DataFrame:
    """(key, group_id): rows in a seeded order, cut into ceil(all tokens / length) groups of equal number; the first
    groups have one more where it doesn't come out even. Without a length each row is a group."""
    rows = df.select(F.col(key).alias("key"), tokens.alias("n"))
    total = rows.agg(F.sum("n").alias("t"), F.count("*").alias("c")).first()
    count = total["c"]
    groups = count if length <= 0 else max(1, -(-int(total["t"] or 0) // length))
    placed = ranked(rows.select("key"), seeded(F.col("key"), seed), "place")
    small, more = divmod(count, groups)
    edge = more * (small + 1)
    at = F.col("place")
    group = F.floor(at / (small + 1)) if not small else F.when(at < edge, F.floor(at / (small + 1))).otherwise(more + F.floor((at - edge) / small))
    return placed.select(F.col("key").alias(key), group.cast("long").alias("group_id"))


def group_contexts(groups: DataFrame, texts: DataFrame, key: str, text: str, separator: str = "\n\n", seed: int = 0) -> DataFrame:
    """(group_id, context): the texts of each group in a seeded order, joined."""
    j = groups.join(texts.select(key, F.col(text).alias("t")), key)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(seeded(F.col(key), seed).alias("k"), F.col("t")))), lambda x: x["t"])
    return j.groupBy("group_id").agg(F.array_join(parts, separator).alias("context"))


def length_bucket(tokens: Column, width: int = 100) -> Column:
    """The number of the bucket, from 1, of a length."""
    return F.ceil(tokens / width).cast("int")


def pick_by_hash(options: Column, key: Column, seed: int = 0) -> Column:
    """One element, the same for the same key and seed; null of none."""
    h = F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("long")
    return F.get(options, F.pmod(h, F.greatest(F.size(options), F.lit(1)).cast("long")).cast("int"))


def task_choice(key: Column, frequency: float, seed: int = 0) -> Column:
    """RECON with a frequency, else COMP; the same for the same key and seed."""
    u = F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("long") / float(16**8)
    return F.when(u < frequency, "RECON").otherwise("COMP")


def group_lengths(index: DataFrame, texts: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(group_id, items, length) of an index (group_id, key), made here or elsewhere, over the texts it names; keys
    without a text are left out."""
    sized = texts.select(key, F.coalesce(tokens, F.lit(0)).alias("_n"))
    return index.join(sized, key).groupBy("group_id").agg(F.count("*").alias("items"), F.sum("_n").cast("long").alias("length"))


def longest(lengths: DataFrame, n: int = 20) -> DataFrame:
    """The n longest groups, of equals those of least id."""
    return lengths.orderBy(F.desc("length"), "group_id").limit(n)
