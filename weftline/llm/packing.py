"""Items into containers of fixed capacity: a grouping genetic algorithm on islands.

An individual is a set of containers, and what is inherited are whole containers. A crossover takes the well-filled
containers of one parent into the other, removes the other's containers that hold any of the same items, and best-fits
the displaced items, the longest first; a mutation empties the worst containers and best-fits their items. Fitness is
the mean squared fill.

Items are spread over shards of about ``SHARD`` items by hash; each shard has ``ISLANDS`` populations, a task each, and
after every epoch an island's best individuals move on to the next island of the shard. What the best individual of a
shard leaves in containers under ``FULL`` is pooled over all shards and packed again, so no shard keeps its own
half-empty ends. An item longer than the capacity is cut into full pieces, each a container, and a rest that is packed.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

CAPACITY = 1150
SHARD, ISLANDS, EPOCHS = 800, 2, 2
POPULATION, GENERATIONS, FULL, POOLS = 6, 14, 0.985, 3

Bins = list[list[int]]


def fit_in_order(items: Iterable[int], sizes: list[int], capacity: int, bins: Bins) -> Bins:
    """``bins`` with the items added in their order, each where the least space stays; items without room open a
    container. A bit set of the free spaces that occur finds the least that suffices."""
    room: dict[int, list[int]] = {}
    mask = 0
    for b, held in enumerate(bins):
        free = capacity - sum([sizes[i] for i in held])
        if free in room:
            room[free].append(b)
        else:
            room[free] = [b]
            mask |= 1 << free
    for i in items:
        size = sizes[i]
        fits = mask >> size
        if fits:
            free = (fits & -fits).bit_length() - 1 + size
            same = room[free]
            b = same.pop()
            if not same:
                del room[free]
                mask ^= 1 << free
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = free - size
        if left in room:
            room[left].append(b)
        else:
            room[left] = [b]
            mask |= 1 << left
    return bins


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: Bins) -> Bins:
    """``fit_in_order``, the longest first."""
    return fit_in_order(sorted(items, key=sizes.__getitem__, reverse=True), sizes, capacity, bins)


def fitness(bins: Bins, sizes: list[int], capacity: int) -> float:
    return sum([sum([sizes[i] for i in b]) ** 2 for b in bins]) / (capacity * capacity * len(bins)) if bins else 0.0


def crossover(giver: Bins, taker: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    fills = [sum([sizes[i] for i in b]) for b in giver]
    bar = capacity * rng.choice((1.0, 0.995, 0.98))
    inject = [b for b, f in zip(giver, fills) if f >= bar and rng.random() < 0.7]
    taken = {i for b in inject for i in b}
    kept: Bins = [list(b) for b in inject]
    displaced: list[int] = []
    for b in taker:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    return best_fit(displaced, sizes, capacity, kept)


def mutate(bins: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """The containers that are filled worst, and a few others, are emptied and their items best-fitted."""
    order = sorted(range(len(bins)), key=lambda b: sum([sizes[i] for i in bins[b]]))
    out = set(order[: max(2, len(order) // 12)]) | {rng.randrange(len(bins)) for _ in range(max(1, len(bins) // 25))}
    loose = [i for b in out for i in bins[b]]
    kept = [list(b) for k, b in enumerate(bins) if k not in out]
    if rng.random() < 0.3:
        return best_fit(loose, sizes, capacity, kept)
    # jittered sizes give another order, hence another packing
    jitter = {i: sizes[i] * rng.uniform(0.8, 1.25) for i in loose}
    return fit_in_order(sorted(loose, key=jitter.__getitem__, reverse=True), sizes, capacity, kept)


def evolve(sizes: list[int], capacity: int, start: list[Bins], rng: random.Random, generations: int = GENERATIONS, population: int = POPULATION) -> list[Bins]:
    """The individuals after some generations, the best first."""
    n = list(range(len(sizes)))
    if not n:
        return [[]]
    people = [[list(b) for b in x] for x in start] or [best_fit(n, sizes, capacity, [])]
    while len(people) < population:
        jitter = [s * rng.uniform(0.7, 1.3) for s in sizes]
        people.append(fit_in_order(sorted(n, key=jitter.__getitem__, reverse=True), sizes, capacity, []))
    least = math.ceil(sum(sizes) / capacity)
    scored = sorted(((fitness(p, sizes, capacity), k, p) for k, p in enumerate(people)), reverse=True)
    serial = len(people)
    for _ in range(generations):
        if len(scored[0][2]) <= least and scored[0][0] > 0.9999:
            break
        children = []
        for _ in range(population // 2):
            a, b = rng.sample(range(len(scored)), 2)
            giver, taker = scored[min(a, b)][2], scored[max(a, b)][2]
            child = crossover(giver, taker, sizes, capacity, rng)
            if rng.random() < 0.6 and child:
                child = mutate(child, sizes, capacity, rng)
            children.append((fitness(child, sizes, capacity), serial, child))
            serial += 1
        scored = sorted(scored + children, reverse=True)[:population]
    return [p for _, _, p in scored]


_PIECE = "id long, length long, piece int, tokens int"
_KEY = ["id", "length", "piece"]


def _islands(capacity: int, seed: int):
    """(shard, island, id, length, piece, tokens, origin, rank, bin) of individuals -> the two best individuals after an epoch."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(key[0]), int(key[1])
        pdf = pdf.sort_values([*_KEY, "origin", "rank"], kind="stable")
        items = pdf[[*_KEY, "tokens"]].drop_duplicates(_KEY)
        index = {x: k for k, x in enumerate(zip(*(items[c] for c in _KEY)))}
        sizes = items["tokens"].tolist()
        start = []
        for _, x in pdf[pdf["bin"] >= 0].groupby(["origin", "rank"], sort=True):
            bins: dict[int, list[int]] = {}
            for *key, b in zip(*(x[c] for c in _KEY), x["bin"]):
                bins.setdefault(b, []).append(index[tuple(key)])
            start.append(list(bins.values()))
        best = evolve(sizes, capacity, start, random.Random(f"{seed}/{shard}/{island}/{len(start)}"))
        parts = []
        for rank, bins in enumerate(best[:2]):
            of = [0] * len(sizes)
            for b, held in enumerate(bins):
                for i in held:
                    of[i] = b
            parts.append(items.assign(shard=shard, island=island, origin=island, rank=rank, bin=of, fitness=fitness(bins, sizes, capacity)))
        return pd.concat(parts)[["shard", "island", *_KEY, "tokens", "origin", "rank", "bin", "fitness"]]

    return run


def _round(pieces: DataFrame, capacity: int, seed: int, shards: int, name: str, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(id, length, piece, tokens, container, fill) of pieces, packed in ``shards`` shards."""
    shard = F.pmod(F.xxhash64(*_KEY, F.lit(seed)), F.lit(shards)).cast("int")
    state = pieces.select(shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), *_KEY, "tokens", F.lit(0).alias("origin"), F.lit(0).alias("rank"), F.lit(-1).alias("bin"))
    schema = f"shard int, island int, {_PIECE}, origin int, rank int, bin int, fitness double"
    for epoch in range(epochs):
        # few bytes and much work: as many partitions as keep all cores busy, which a number given here fixes
        tasks = min(shards * islands, max(2 * pieces.sparkSession.sparkContext.defaultParallelism, shards * islands // 8))
        state = state.repartition(tasks, "shard", "island")
        state = materialize(state.groupBy("shard", "island").applyInPandas(_islands(capacity, seed + epoch), schema), "islands")
        if epoch + 1 < epochs:
            # everyone stays, and the best of each island also goes to the next one
            on = F.when((F.col("rank") == 0) & F.lit(islands > 1), F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(islands)))).otherwise(F.array("island"))
            state = state.withColumn("island", F.explode(on)).drop("fitness")
    best = state.where("rank = 0").groupBy("shard").agg(F.max_by("island", F.struct("fitness", -F.col("island"))).alias("island"))
    chosen = state.where("rank = 0").join(best, ["shard", "island"])
    named = chosen.select(*_KEY, "tokens", F.concat_ws("-", F.lit(name), "shard", "bin").alias("container"))
    fills = named.groupBy("container").agg(F.sum("tokens").cast("int").alias("fill"))
    return materialize(named.join(fills, "container").select(*_KEY, "tokens", "container", "fill"), "packed")


def pack(items: DataFrame, id_column: str, tokens: Column, capacity: int = CAPACITY, seed: int = 0, shard: int = SHARD) -> DataFrame:
    """Rows (id, length, piece, start, tokens, container, fill) for every item: in which container each of its pieces
    is, and how many tokens that container holds.

    Items up to the capacity have one piece, 0. Items of no or null length are pieces of no tokens and share containers
    like others. A repeated id is a further item if its length differs, else it counts once.
    Null ids are left out. An empty table gives no rows. Other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    sized = items.select(F.col(id_column).cast("long").alias("id"), F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)).cast("long").alias("length")).where("id is not null").distinct()
    cut = F.when(F.col("length") <= capacity, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil(F.col("length") / capacity).cast("int") - 1))
    pieces = sized.select("id", "length", F.explode(cut).alias("piece")).select(
        *_KEY, F.least(F.lit(capacity), F.col("length") - F.col("piece") * F.lit(capacity)).cast("int").alias("tokens")
    )
    pieces = materialize(pieces, "pieces")
    whole = pieces.where(F.col("tokens") == capacity).select(*_KEY, "tokens", F.concat_ws("-", F.lit("whole"), *_KEY).alias("container"), F.col("tokens").alias("fill"))
    loose = pieces.where(F.col("tokens") < capacity)
    done = [whole]
    n = loose.count()
    for k in range(POOLS):
        if not n:
            break
        shards = max(1, round(n / shard))
        packed = _round(loose, capacity, seed + 101 * k, shards, str(k))
        if shards == 1 or k == POOLS - 1:
            done.append(packed)
            break
        done.append(packed.where(F.col("fill") >= FULL * capacity))
        loose = packed.where(F.col("fill") < FULL * capacity).select(*_KEY, "tokens")
        n = loose.count()
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(*_KEY, (F.col("piece").cast("long") * capacity).alias("start"), "tokens", "container", "fill")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row (containers, tokens, least_containers, fill): fill is of the space of all containers."""
    c = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return c.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens")).select(
        "containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("fill")
    )
