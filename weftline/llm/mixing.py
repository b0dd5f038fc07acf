"""Mixing sources to target weights: temperature, repetition limits and budgeted block permutations.

Temperature mixing raises the sources' token shares to an exponent; 1 leaves them, 0 makes all equal. The exponent is
bisected to meet an entropy, or as far as no source repeats more than it may. Where a share is given for each source,
the targets are the base measure in place of equal shares: weights are target^(1-x) * natural^x, normalised, and x is
bisected to the least at which no source is repeated more than it may. A source whose target alone is out of reach
gives all it may, and the others share what is left in the same way, so the wanted total is reached if the sources can
reach it at all; the exponent and what each source reached are reported.

Weights become rows by block permutations. A source's rows are cut into blocks by a hash; a budget of k times its
tokens and some more takes every row k times and then, block by block in an order of hashes, rows until the rest is
filled. Block sums are made before anything is ordered, and only the block in which the budget ends is looked into, so a
source with a third of all rows is never sorted as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import materialize
from ..functions.tokens import VOCABULARY, count_tokens

BLOCK_ROWS = 2000


def source_key(column: Column) -> Column:
    """A source without regard to case, blanks and the sign between its parts; null for null and blank."""
    return F.nullif(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def entropy(shares: list[float]) -> float:
    return -math.fsum(p * math.log(p) for p in shares if p > 0)


def tempered(tokens: dict[str, float], exponent: float) -> dict[str, float]:
    """The shares of sources after raising their token shares to the exponent; sources without tokens have none."""
    total = sum(tokens.values())
    raw = {s: (n / total) ** exponent if n > 0 else 0.0 for s, n in tokens.items()}
    norm = math.fsum(raw.values())
    return {s: v / norm for s, v in raw.items()} if norm else raw


def _bisect(good, lo: float = 0.0, hi: float = 1.0, steps: int = 60) -> float:
    """The least x in [lo, hi] from which on ``good`` holds; hi if it holds nowhere below."""
    if good(lo):
        return lo
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if good(mid) else (mid, hi)
    return hi


def exponent_for_entropy(tokens: dict[str, float], wanted: float) -> float:
    """The exponent in [0, 1] at which the shares' entropy falls to ``wanted``; 1 if even natural shares have more."""
    return _bisect(lambda x: entropy(list(tempered(tokens, x).values())) <= wanted + 1e-12)


def exponent_for_repeats(tokens: dict[str, float], total: float, limits: dict[str, int]) -> float:
    """The least exponent in [0, 1], that is the most even mix, at which no source repeats more than it may."""
    return _bisect(lambda x: all(w * total <= limits.get(s, 1) * tokens[s] + 1e-6 for s, w in tempered(tokens, x).items()))


def lean_to_natural(targets: dict[str, float], tokens: dict[str, float], total: float, limits: dict[str, int]) -> tuple[float, dict[str, float]]:
    """The least x, and the shares target^(1-x) * natural^x, at which no source with tokens repeats more than it may."""
    have = sum(tokens.get(s, 0) for s in targets)

    def shares(x: float) -> dict[str, float]:
        raw = {s: (t ** (1 - x)) * (tokens[s] / have) ** x for s, t in targets.items() if t > 0 and tokens.get(s, 0) > 0}
        norm = math.fsum(raw.values())
        return {s: v / norm for s, v in raw.items()}

    x = _bisect(lambda x: all(w * total <= limits[s] * tokens[s] + 1e-6 for s, w in shares(x).items()))
    return x, shares(x)


def fitted_weights(targets: dict[str, float], tokens: dict[str, float], total: float, limits: dict[str, int]) -> tuple[float, dict[str, float]]:
    """The exponent and the normalised weight of each source that has tokens.

    Sources whose target is out of reach have the weight of all they may give; the others' weights are
    ``lean_to_natural`` of what is left. What even x = 1 would repeat too often joins the first. Weights sum to 1 unless
    all sources together can't reach the total.
    """
    most = {s: limits[s] * tokens.get(s, 0.0) / total if total > 0 else 0.0 for s in targets}
    held = {s: most[s] for s, t in targets.items() if t > 0 and most[s] > 0 and t > most[s]}
    while True:
        free = {s: t for s, t in targets.items() if t > 0 and most[s] > 0 and s not in held}
        left = 1.0 - math.fsum(held.values())
        if not free or left <= 0:
            return 0.0, held
        x, shares = lean_to_natural(free, tokens, left * total, limits)
        over = {s: most[s] for s, w in shares.items() if left * w * total > limits[s] * tokens[s] + 1e-5}
        if not over:
            return x, held | {s: left * w for s, w in shares.items()}
        held |= over


def sized(docs: DataFrame, targets: DataFrame | None, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, key, tokens) of rows with an id and a source, of targets' sources only where there are targets."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), source_key(F.col(source)).alias("key"), F.col(text).alias("text")).where("doc_id is not null and key is not null")
    if targets is not None:
        rows = rows.join(targets.select(source_key(F.col("source")).alias("key")).distinct(), "key", "left_semi")
    return materialize(count_tokens(rows, ["doc_id", "key"], F.array("text"), path), "sized")


def take(rows: DataFrame, budgets: dict[str, tuple[float, int]], counts: dict[str, tuple[int, int]], seed: int = 0) -> DataFrame:
    """(doc_id, key, tokens, repeats) of the rows that fill each source's (budget, most repeats).

    counts has a source's (rows, tokens). A source's last, partial pass takes rows in order while that brings it
    nearer to what is left of the budget, so it misses the budget by half a row at most. Rows without tokens are taken with full passes
    only.
    """
    plan = {}
    for s, (budget, most) in budgets.items():
        n, tokens = counts.get(s, (0, 0))
        if not tokens or budget <= 0 or most < 1:
            continue
        budget = min(budget, most * tokens)
        passes = min(most, int(budget // tokens))
        rest = budget - passes * tokens if passes < most else 0.0
        plan[s] = (passes, rest, max(1, math.ceil(n / BLOCK_ROWS)))
    if not plan:
        return rows.select("doc_id", "key", "tokens", F.lit(0).alias("repeats")).limit(0)

    def of(i: int, kind: str) -> Column:  # a source has one entry: as many as there are targets
        return F.create_map(*[F.lit(x) for s, p in plan.items() for x in (s, p[i])])[F.col("key")].cast(kind)

    rows = rows.where(F.col("key").isin(list(plan))).select("doc_id", "key", "tokens", of(0, "int").alias("passes"), of(1, "double").alias("rest"), of(2, "int").alias("blocks"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).cast("int"))
    sums = rows.groupBy("key", "block").agg(F.sum("tokens").alias("size"), F.first("rest").alias("rest"))
    order = W.partitionBy("key").orderBy(F.xxhash64("block", F.lit(seed + 1)), "block")
    sums = sums.withColumn("end", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    # of each block: what is left of the budget when it begins
    left = sums.select("key", "block", "size", (F.col("rest") - (F.col("end") - F.col("size"))).alias("left"))
    rows = rows.join(left, ["key", "block"])
    whole = rows.where((F.col("size") <= F.col("left")) | (F.col("left") <= 0)).withColumn("more", (F.col("left") > 0).cast("int") * (F.col("size") <= F.col("left")).cast("int"))
    within = W.partitionBy("key", "block").orderBy(F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    edge = rows.where((F.col("size") > F.col("left")) & (F.col("left") > 0)).withColumn("more", (F.sum("tokens").over(within) - F.col("tokens") / 2 <= F.col("left")).cast("int"))
    both = whole.unionByName(edge)
    return both.select("doc_id", "key", "tokens", (F.col("passes") + F.col("more")).alias("repeats")).where("repeats > 0")


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, share_of_corpus: float = 0.45, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, path: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, source, tokens, repeats, target_share, weight, exponent, reached_share) of the chosen rows.

    ``targets`` has (source, target_share, max_repeats), a row a source, however written; shares are divided by their
    sum and null limits are 1. The wanted total is ``total_tokens``, or that share of the tokens of all of docs. A
    source's weight is of the wanted total (``fitted_weights``), its reached share of what was reached in all. Sources without rows reach nothing and have no row here; see
    ``mix_report``. Null and empty texts have no tokens. A repeated id is a row of its own. Other columns are ignored.
    """
    if total_tokens is None:
        everything = sized(docs, None, doc_id, text, source, path)
        rows = everything.join(targets.select(source_key(F.col("source")).alias("key")).distinct(), "key", "left_semi")
        total = share_of_corpus * (everything.agg(F.sum("tokens")).first()[0] or 0)
    else:
        rows = sized(docs, targets, doc_id, text, source, path)
        total = float(total_tokens)
    counts = {r["key"]: (r["n"], r["tokens"] or 0) for r in rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).collect()}
    wanted = targets.select("source", source_key(F.col("source")).alias("key"), "target_share", "max_repeats").where("target_share is not null").collect()
    norm = math.fsum(r["target_share"] for r in wanted) or 1.0
    shares = {r["key"]: r["target_share"] / norm for r in wanted}
    limits = {r["key"]: 1 if r["max_repeats"] is None else int(r["max_repeats"]) for r in wanted}
    exponent, weights = fitted_weights(shares, {s: float(n) for s, (_, n) in counts.items()}, total, limits)
    chosen = materialize(take(rows, {s: (w * total, limits[s]) for s, w in weights.items()}, counts, seed), "chosen")
    reached = {r["key"]: r["n"] for r in chosen.groupBy("key").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("n")).collect()}
    got = sum(reached.values()) or 1
    names = {r["key"]: r["source"] for r in wanted}

    def of(table: dict) -> Column:
        return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("key")] if table else F.lit(None)

    return chosen.select(
        "doc_id", of(names).cast("string").alias("source"), "tokens", "repeats", of(shares).cast("double").alias("target_share"), of(weights).cast("double").alias("weight"), F.lit(float(exponent)).alias("exponent"), of({s: n / got for s, n in reached.items()}).cast("double").alias("reached_share")
    )


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row (source, target_share, weight, exponent, reached_share, tokens, rows, most_repeats) for each source of
    targets."""
    per = mixed.groupBy(F.col("source").alias("s")).agg(*[F.first(c).alias(c) for c in ("weight", "exponent", "reached_share")], F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("rows"), F.max("repeats").alias("most_repeats"))
    zero = {"weight": 0.0, "exponent": 0.0, "reached_share": 0.0, "tokens": 0, "rows": 0, "most_repeats": 0}
    return targets.join(per, targets["source"] == per["s"], "left").select("source", "target_share", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in zero.items()])


def temperature_mix(docs: DataFrame, total_tokens: int | None = None, entropy_share: float = 0.97, max_repeats: int = 4, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, path: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, source, tokens, repeats, natural_share, weight, exponent): sources mixed without given targets.

    The exponent is bisected so that the entropy of the weights is ``entropy_share`` of that of equal weights, and
    raised as far as no source needs more than ``max_repeats``. The wanted total is by default as much as there is.
    source is the source's key. Same cases as ``mix``.
    """
    rows = sized(docs, None, doc_id, text, source, path)
    counts = {r["key"]: (r["n"], r["tokens"] or 0) for r in rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).collect()}
    tokens = {s: float(n) for s, (_, n) in counts.items() if n}
    total = float(total_tokens) if total_tokens is not None else sum(tokens.values())
    if not tokens:
        return rows.select("doc_id", F.col("key").alias("source"), "tokens", F.lit(0).alias("repeats"), *[F.lit(0.0).alias(c) for c in ("natural_share", "weight", "exponent")]).limit(0)
    x = max(exponent_for_entropy(tokens, entropy_share * math.log(max(2, len(tokens)))), exponent_for_repeats(tokens, total, {s: max_repeats for s in tokens}))
    weights = tempered(tokens, x)
    chosen = take(rows, {s: (w * total, max_repeats) for s, w in weights.items()}, counts, seed)
    table = lambda t: F.create_map(*[F.lit(x) for kv in t.items() for x in kv])[F.col("key")]
    have = sum(tokens.values())
    return chosen.select("doc_id", F.col("key").alias("source"), "tokens", "repeats", table({s: n / have for s, n in tokens.items()}).alias("natural_share"), table(weights).alias("weight"), F.lit(x).alias("exponent"))
