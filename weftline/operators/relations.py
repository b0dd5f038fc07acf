"""Joins, set operations, ordering, sampling and splits, as DataFrame -> DataFrame functions.

Order is always a column; what a seed decides is decided by md5 of the key and the seed, which any engine can repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import materialize


def seeded(key: Column, seed: int) -> Column:
    """A text by which rows are shuffled: the same key and seed give the same place everywhere."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))


def ranked(df: DataFrame, order: Column, name: str) -> DataFrame:
    """``df`` with its place from 0 in an order of unique values, without sorting in one task: a range partitioning,
    and each partition's places counted on from the sizes of those before it. Written to the shared folder first, so
    both looks at it see the same partitions."""
    keyed = materialize(df.withColumn("_k", order).repartitionByRange("_k").sortWithinPartitions("_k").withColumn("_i", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_i", 33)
    sizes = keyed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return keyed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))).drop("_k", "_i", "_part", "_before")


def running(df: DataFrame, order: Column, value: Column, name: str) -> DataFrame:
    """``df`` with the running total of a number in an order of unique values, the row's own included: as ``ranked``, a
    range partitioning, totals within partitions, and the sums of those before."""
    keyed = materialize(df.withColumn("_k", order).withColumn("_v", value).repartitionByRange("_k").withColumn("_part", F.spark_partition_id()), "running")
    sizes = keyed.groupBy("_part").agg(F.sum("_v").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row a partition
    within = F.sum("_v").over(W.partitionBy("_part").orderBy("_k").rowsBetween(W.unboundedPreceding, 0))
    return keyed.withColumn("_s", within).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_s")).drop("_k", "_v", "_s", "_part", "_before")


def last_wins(df: DataFrame, keys: list[str], pos: Column) -> DataFrame:
    """The row of highest ``pos`` for each key, the rest left out. Pre-aggregates before the shuffle, so a hot key
    costs no more than others; of equal positions any one row stays. Rows whose keys are null count as one key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(pos.alias("p"), F.xxhash64(*rest).alias("h"))).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def one_sided(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row (both, only_a, only_b): how many distinct keys stand on which sides; null keys don't count."""
    sides = a.select(F.col(key).alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(F.col(key), F.lit(0), F.lit(1))).where("k is not null")
    per = sides.groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return per.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"), F.count_if(F.col("b") == 0).alias("only_a"), F.count_if(F.col("a") == 0).alias("only_b"))


def pending(work: DataFrame, done: list[DataFrame], key: str) -> DataFrame:
    """The rows of ``work`` whose key isn't done; done is what all of several logs have. Without logs all is pending."""
    if not done:
        return work
    ids = done[0].select(key)
    for d in done[1:]:
        ids = ids.intersect(d.select(key))
    return work.join(ids.distinct(), key, "left_anti")


def match_or_position(results: DataFrame, entries: DataFrame, key: str, pos: str) -> DataFrame:
    """Each result with its entry: of the same key, else the entry at the result's position. Results without either
    are left out; of entries with the same key the last counts. Columns of the entry are in a struct ``entry``."""
    e = entries.select(F.col(key).alias("_k"), F.col(pos).alias("_p"), F.struct(*entries.columns).alias("entry"))
    by_key = last_wins(e, ["_k"], F.col("_p")).select("_k", F.col("entry").alias("_by_key"))
    by_pos = e.select("_p", F.col("entry").alias("_by_pos"))
    out = results.join(by_key, results[key] == F.col("_k"), "left").join(by_pos, results[pos] == F.col("_p"), "left")
    return out.withColumn("entry", F.coalesce("_by_key", "_by_pos")).drop("_k", "_p", "_by_key", "_by_pos").where("entry is not null")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in a seeded order, all if there are fewer; a top-n, without sorting everything."""
    return df.orderBy(seeded(F.col(key), seed), F.col(key)).limit(n)


def at_positions(df: DataFrame, pos: str, wanted: list[int]) -> DataFrame:
    """The rows at the wanted positions; those out of bounds are left out."""
    return df.where(F.col(pos).isin([int(i) for i in wanted]))


def from_position(df: DataFrame, pos: str, start: int = 0, limit: int | None = None) -> DataFrame:
    """The rows from a position on, the first ``limit`` of them in order."""
    out = df.where(F.col(pos) >= start)
    return out if limit is None else out.orderBy(pos).limit(limit)


def row_split(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """``df`` with a column ``held``: true for about ``share`` of the rows, by the first 13 hex digits of the seeded
    order as a fraction."""
    fraction = F.conv(F.substring(seeded(F.col(key), seed), 1, 13), 16, 10).cast("long") / float(16**13)
    return df.withColumn("held", fraction < share)


def group_split(df: DataFrame, group: str, eval_ratio: float, test_ratio: float, seed: int = 42) -> DataFrame:
    """``df`` with a column ``split``: groups in a seeded order go to test first, then eval, then train.

    max(1, round(n * ratio)) groups each, halves rounded to even, so of one group all rows are test. Null groups are
    train. Ranks are given to groups, not rows: the one ordering is over distinct groups.
    """
    groups = df.select(group).where(F.col(group).isNotNull()).distinct()
    counts = groups.agg(F.count("*").alias("n")).select(
        F.greatest(F.lit(1), F.bround(F.col("n") * test_ratio)).cast("long").alias("n_test"), F.greatest(F.lit(1), F.bround(F.col("n") * eval_ratio)).cast("long").alias("n_eval")
    )
    placed = ranked(groups, F.struct(seeded(F.col(group), seed), F.col(group)), "_place").withColumn("_rank", F.col("_place") + 1)
    sides = placed.join(F.broadcast(counts)).select(  # counts is one row
        group, F.when(F.col("_rank") <= F.col("n_test"), "test").when(F.col("_rank") <= F.col("n_test") + F.col("n_eval"), "eval").otherwise("train").alias("split")
    )
    return df.join(sides, group, "left").withColumn("split", F.coalesce("split", F.lit("train"))).select(*df.columns, "split")


def numbered(df: DataFrame, order: list[str], form: str, column: str = "number", start: int = 0) -> DataFrame:
    """``df`` with ids of a format like sp_%05d, in an order of unique values; number before any filter, and gaps stay
    where rows go."""
    return ranked(df, F.struct(*order), "_place").withColumn(column, F.format_string(form, F.col("_place") + start)).drop("_place")


def latest(df: DataFrame, pos: str, n: int = 100) -> DataFrame:
    """The n rows of highest position."""
    return df.orderBy(F.col(pos).desc()).limit(n)


def widen(df: DataFrame, key: str, label: str, labels: list[str], value: Column) -> DataFrame:
    """One row for each key, with a column for each label that holds its value; missing ones are null."""
    return df.groupBy(key).pivot(label, labels).agg(F.first(value, ignorenulls=True))


def distinct_texts(df: DataFrame, text: str, pos: str) -> DataFrame:
    """(text, first_pos, n): distinct texts in the order of their first appearance, grouped by their hash; null is
    none."""
    g = df.where(F.col(text).isNotNull()).groupBy(F.sha2(F.col(text), 256).alias("_h")).agg(F.first(text).alias(text), F.min(pos).alias("first_pos"), F.count("*").alias("n"))
    return g.drop("_h")
