"""Profiles and aggregates: statistic packs, histograms, weighted losses, rolling windows, vector statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .relations import ranked, running


def finite(x: Column) -> Column:
    """The number, or null for NaN and infinities."""
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")), x)


def stat_pack(x: Column, digits: int | None = None) -> list[Column]:
    """n, mean, population std, median, p10 and p90 (interpolated) of finite numbers; null without any."""
    v = finite(x.cast("double"))
    cols = {"mean": F.avg(v), "std": F.stddev_pop(v), "median": F.percentile(v, 0.5), "p10": F.percentile(v, 0.1), "p90": F.percentile(v, 0.9)}
    return [F.count(v).alias("n"), *[(F.round(c, digits) if digits is not None else c).alias(k) for k, c in cols.items()]]


def quantiles(df: DataFrame, by: list[str], x: Column, probs: dict[str, float]) -> DataFrame:
    """(*by, n, one column for each of ``probs``): exact, interpolated quantiles of finite numbers, as ``percentile``
    gives them, without a table of all values of a group in one task.

    Equal values are counted first; running totals over the range-partitioned values give each one its ranks, and only
    the values at the wanted ranks are kept. Groups without any number have no row. Null is a group.
    """
    v = finite(x.cast("double"))
    counted = df.select(*by, v.alias("_x")).where("_x is not null").groupBy(*by, "_x").agg(F.count("*").alias("_c"))
    total = running(counted, F.struct(*by, "_x"), F.col("_c"), "_to").withColumn("_from", F.col("_to") - F.col("_c"))
    groups = total.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).agg(F.min("_from").alias("_start"), F.sum("_c").alias("n"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    at = total.join(groups, same, "inner").select(*by, "_x", (F.col("_from") - F.col("_start")).alias("_lo"), (F.col("_to") - F.col("_start")).alias("_hi"), "n")
    aggs = [F.max("n").alias("n")]
    for name, p in probs.items():
        rank = F.lit(p) * (F.col("n") - 1)
        held = lambda r: F.max(F.when((F.col("_lo") <= r) & (r < F.col("_hi")), F.col("_x")))
        low, high = held(F.floor(rank)), held(F.ceil(rank))
        share = F.max(rank - F.floor(rank))
        aggs.append(((1 - share) * low + share * high).alias(name))
    return at.groupBy(*by).agg(*aggs)


def stat_table(df: DataFrame, by: list[str], x: Column, digits: int = 6) -> DataFrame:
    """The statistic pack of ``stat_pack`` by groups, with quantiles that no single task has to hold the values for."""
    v = finite(x.cast("double"))
    plain = df.groupBy(*by).agg(F.count(v).alias("n"), F.round(F.avg(v), digits).alias("mean"), F.round(F.stddev_pop(v), digits).alias("std"))
    q = quantiles(df, by, x, {"median": 0.5, "p10": 0.1, "p90": 0.9}).drop("n")
    q = q.select(*[F.col(c).alias(f"_{c}") for c in by], *[F.round(c, digits).alias(c) for c in ("median", "p10", "p90")])
    return plain.join(q, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left").drop(*[f"_{c}" for c in by])


def profile(df: DataFrame, by: str, lengths: list[str], digits: int = 6) -> DataFrame:
    """Per value of ``by`` and in all (null, ``total`` true): n and mean, median, min and max of each length."""
    aggs = [F.count("*").alias("n")]
    for c in lengths:
        aggs += [F.round(F.avg(c), digits).alias(f"{c}_mean"), F.round(F.percentile(c, 0.5), digits).alias(f"{c}_median"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.rollup(by).agg(F.grouping(by).cast("boolean").alias("total"), *aggs)


def histogram(df: DataFrame, x: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): bins from 1; 0 holds what is under, bins + 1 what is at or over the range. Nulls are left out."""
    return df.select(F.width_bucket(x.cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def weighted_loss(loss: Column, weight: Column, cap: float = 20.0) -> list[Column]:
    """Mean loss by weight, and its exponential, infinite from ``cap`` on; a mean of 0 without weight."""
    mean = F.coalesce(F.sum(loss * weight), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(weight), F.lit(0.0)), F.lit(1.0))
    return [mean.alias("loss"), F.when(mean >= cap, F.lit(float("inf"))).otherwise(F.exp(mean)).alias("ppl")]


def sample_ppl(loss: Column, digits: int | None = None) -> list[Column]:
    """The statistic pack of each sample's perplexity."""
    return stat_pack(F.exp(loss), digits)


def rolling(df: DataFrame, by: list[str], order: list[str], x: str, size: int = 50, block: int = 100_000) -> DataFrame:
    """``df`` with number, sum, mean, min, max and sample std of the last ``size`` values up to each row of its group.

    Rows get their places in the order of group and ``order``, range-partitioned; windows run within blocks of places,
    and the last size - 1 rows of a block also stand at the head of the next. So a group with a third of all rows is
    spread over as many tasks as any other rows. Runs a job when called. Nulls don't count; of rows with equal order
    any may come first.
    """
    block = max(block, size)
    placed = ranked(df, F.struct(*by, *order), "_place")
    at = F.floor(F.col("_place") / block)
    heads_next = F.col("_place") % block > block - size
    spread = placed.withColumn("_at", at).withColumn("_block", F.explode(F.when(heads_next, F.array(at, at + 1)).otherwise(F.array(at))))
    w = W.partitionBy("_block", *by).orderBy("_place").rowsBetween(1 - size, 0)
    stats = {"n": F.count(x), "sum": F.sum(x), "mean": F.avg(x), "min": F.min(x), "max": F.max(x), "std": F.stddev_samp(x)}
    out = spread.select("*", *[c.over(w).alias(f"roll_{k}") for k, c in stats.items()]).where("_at = _block")
    return out.select(*df.columns, *[f"roll_{k}" for k in stats])


def per_turn(scores: DataFrame, conv: str, turn: str, score: str, turns: int) -> DataFrame:
    """(turn, score_sum, counted, mean): conversations of exactly ``turns`` turns are summed, the mean divides by all
    conversations, the skipped ones included."""
    size = W.partitionBy(conv)
    whole = scores.withColumn("_n", F.count("*").over(size))
    every = scores.agg(F.count_distinct(conv).alias("_all"))
    g = whole.where(F.col("_n") == turns).groupBy(turn).agg(F.sum(score).alias("score_sum"), F.count("*").alias("counted"))
    return g.join(F.broadcast(every)).select(turn, "score_sum", "counted", (F.col("score_sum") / F.col("_all")).alias("mean"))  # every is one row


def per_conversation(scores: DataFrame, conv: str, score: str, error: Column) -> DataFrame:
    return scores.groupBy(conv).agg(F.avg(score).alias("mean"), F.count_if(error).alias("errors"))


def rates(df: DataFrame, flags: list[str]) -> DataFrame:
    """One row: n and the share of rows for which each flag holds, 0 of none."""
    return df.agg(F.count("*").alias("n"), *[F.coalesce(F.avg(F.col(f).cast("double")), F.lit(0.0)).alias(f) for f in flags])


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector of zeros."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.nullif(dot, F.lit(None)) / F.nullif(l2_norm(a) * l2_norm(b), F.lit(0.0))


def vector_stats(df: DataFrame, key: str, vector: str, most: int = 20) -> DataFrame:
    """One row: n, mean norm, and mean, sample std, min and max of the cosines of all pairs of the first ``most``
    vectors by key. The number of vectors is the feature: a bounded sample, so the pairs are few."""
    some = df.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("v is not null").orderBy("k").limit(most)
    norms = some.agg(F.count("*").alias("n"), F.avg(l2_norm(F.col("v"))).alias("norm_mean"))
    pairs = some.alias("a").join(some.alias("b"), F.col("a.k") < F.col("b.k")).select(cosine(F.col("a.v"), F.col("b.v")).alias("c"))
    return norms.join(F.broadcast(pairs.agg(F.avg("c").alias("cos_mean"), F.stddev_samp("c").alias("cos_std"), F.min("c").alias("cos_min"), F.max("c").alias("cos_max"))))
