"""The queries of this subpackage over the test tables, with their production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import cross_split, language, leakage, mixing, near_duplicates, packing, pair_defects, splits
from ..functions.tokens import VOCABULARY, count_tokens


#: What the benchmark times.
HEADLINE = ["p1_found", "p2_found", "p3_found", "p3_assign", "p4_pack", "p5_found", "p6_found", "p7_mix", "p8_found"]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = pair_defects.pair_defects(_table(spark, d, "split_examples"), "example_id")
    return found.where("rank = 0").select(F.col("id").alias("example_id"), "defect")


def p1_all_defects(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects.pair_defects(_table(spark, d, "split_examples"), "example_id").select(F.col("id").alias("example_id"), "defect", "rank")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cross_split.cross_split_pairs(_table(spark, d, "split_examples"))
    return pairs.select(F.least("train_id", "held_id").alias("example_id_a"), F.greatest("train_id", "held_id").alias("example_id_b")).distinct()


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    covered = cross_split.cross_split_coverage(_table(spark, d, "split_examples"))
    return covered.withColumnRenamed("id", "example_id").withColumn("coverage", F.round("coverage", 4)).withColumn("verbatim", F.round("verbatim", 4))


def _as_written(spark: SparkSession, d: str, df: DataFrame, column: str) -> DataFrame:
    """``df`` with canonical ids of prompts written as in system_prompts."""
    ids = splits.written_ids(_table(spark, d, "system_prompts"))
    return df.join(ids, df[column] == ids["canonical"], "left").withColumn(column, F.coalesce("as_written", column)).drop("canonical", "as_written")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    examples = _table(spark, d, "split_examples")
    report = cross_split.overlap_report(examples, cross_split.cross_split_coverage(examples), splits.row_canonical())
    return _as_written(spark, d, report, "source").withColumnRenamed("source", "system_prompt_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_prompts(_table(spark, d, "split_examples"), _table(spark, d, "system_prompts"))


#: Columns that tie rows together beside the prompts they name. Contexts would: but those of the largest prompt also
#: stand under many others, and with all of them in one component its category couldn't keep its shares.
TIED: tuple[str, ...] = ()


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(_table(spark, d, "split_examples"), _table(spark, d, "split_targets"), also=TIED)


def p3_assign(spark: SparkSession, d: str) -> DataFrame:
    rows = splits.assigned_rows(_table(spark, d, "split_examples"), materialize(_assigned(spark, d), "assigned"), "example_id", also=TIED)
    return _as_written(spark, d, rows, "system_prompt_id")


def p3_prompts(spark: SparkSession, d: str) -> DataFrame:
    prompts = _assigned(spark, d).where("system_prompt_id is not null").select("system_prompt_id", "split", "category", "n")
    return _as_written(spark, d, prompts, "system_prompt_id")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    items = _table(spark, d, "ift_data_pwc")
    texts = F.concat(F.array("context"), F.coalesce(F.transform("conversations", lambda c: c["content"]), F.array().cast("array<string>")))
    sized = count_tokens(items, ["item_id"], texts, VOCABULARY)
    return packing.pack(sized, "item_id", F.col("tokens"))


def p4_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).withColumnRenamed("id", "item_id")


def p4_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_duplicates.near_duplicate_pairs(_table(spark, d, "ift_data_pwc"), "item_id", "context")
    return pairs.select(F.col("id_a").alias("item_id_a"), F.col("id_b").alias("item_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(_table(spark, d, "ift_data_pwc"), "item_id", "context").withColumnRenamed("id", "item_id")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_table(spark, d, "documents"), _table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    held = _leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"), F.round(F.max("similarity"), 4).alias("similarity"))
    items = _table(spark, d, "benchmark").select("item_id", "suite")
    return items.join(held, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"), "similarity")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(p7_mix(spark, d), _table(spark, d, "mix_targets"))


def p7_temperature(spark: SparkSession, d: str) -> DataFrame:
    return mixing.temperature_mix(_table(spark, d, "documents"))


def _languages(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return language.detect(docs, language.fit(docs))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(_languages(spark, d))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).select("doc_id", "label", "lang", "confidence")


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).select("doc_id", F.posexplode("passages").alias("passage", "x")).select("doc_id", "passage", "x.*")


# --- what must hold of the choices, in a form that SQL can say ---


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """(rows, torn, off): rows assigned, prompts in more than one split, splits over two points off their share."""
    rows = p3_assign(spark, d).join(_table(spark, d, "split_targets"), "split", "left")
    torn = rows.where("system_prompt_id is not null").groupBy("system_prompt_id").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("torn"))
    per = rows.groupBy("split").agg(F.count("*").alias("n"), F.first("target_share").alias("want"))
    all_ = per.agg(F.sum("n").alias("rows"), F.collect_list(F.struct("n", "want")).alias("s"))  # a row a split
    off = F.size(F.filter("s", lambda x: F.abs(x["n"] / F.col("rows") - F.coalesce(x["want"], F.lit(9.0))) > 0.02))
    return all_.join(F.broadcast(torn)).select("rows", "torn", off.alias("off"))


def p4_kept(spark: SparkSession, d: str) -> DataFrame:
    """(items, overfull, cut, torn): items packed, containers over the capacity, items in pieces that would fit as one,
    and items whose pieces don't follow one another."""
    packed = materialize(_packed(spark, d), "kept")
    full = packed.groupBy("container").agg(F.sum("tokens").alias("n"), F.max("fill").alias("fill")).agg(F.count_if((F.col("n") > packing.CAPACITY) | (F.col("n") != F.col("fill"))).alias("overfull"))
    items = packed.groupBy("id", "length").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("start").alias("last"))
    items = items.agg(
        F.count("*").alias("items"), F.count_if((F.col("pieces") > 1) & (F.col("length") <= packing.CAPACITY)).alias("cut"), F.count_if((F.col("tokens") != F.col("length")) | (F.col("last") != (F.col("pieces") - 1) * packing.CAPACITY)).alias("torn")
    )
    return items.join(F.broadcast(full)).select("items", "overfull", "cut", "torn")


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """(source, max_repeats, over): of each source of the targets, the rows used more often than they may be."""
    targets = _table(spark, d, "mix_targets").select("source", "max_repeats")
    over = p7_mix(spark, d).select("source", "repeats").join(targets, "source").groupBy("source").agg(F.count_if(F.col("repeats") > F.col("max_repeats")).alias("over"))
    return targets.join(over, "source", "left").select("source", "max_repeats", F.coalesce("over", F.lit(0)).alias("over"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_all_defects, p2_found, p2_coverage, p2_report, p3_found, p3_assign, p3_prompts, p3_kept, p4_pack, p4_fill, p4_kept, p5_found, p5_groups, p6_found, p6_items, p7_mix, p7_shares, p7_temperature, p7_kept, p8_found, p8_languages, p8_passages]
    return {f.__name__: f for f in found}


# DuckDB's RE2 has no lookbehind: zeros after the letters are cut with a group.
_CANON = "regexp_replace(regexp_replace(lower({}), '[^\\pL\\pN]+', '', 'g'), '(\\pL)0+([0-9])', '\\1\\2')"
_TOLD = "regexp_extract(question_id, '^(.*)_[qQ][0-9]+\\s*$', 1)"
_PROMPT = f"coalesce(nullif({_CANON.format('system_prompt_id')}, ''), nullif({_CANON.format(_TOLD)}, ''))"


def oracle_sql() -> dict[str, str]:
    """Only what SQL can say on whole tables; the others are tested against brute force in tests/llm."""
    return {
        "p3_kept": "SELECT count(*) AS rows, 0 AS torn, 0 AS off FROM split_examples",
        "p4_kept": "SELECT count(DISTINCT item_id) AS items, 0 AS overfull, 0 AS cut, 0 AS torn FROM ift_data_pwc",
        "p7_kept": "SELECT source, max_repeats, 0 AS over FROM mix_targets",
        "p3_found": f"""
            WITH rows AS (SELECT {_PROMPT} AS canonical, lower(trim(split)) AS side FROM split_examples),
            broken AS (SELECT canonical FROM rows WHERE canonical IS NOT NULL GROUP BY canonical HAVING count(DISTINCT side) > 1)
            SELECT min(p.id) AS system_prompt_id FROM broken b JOIN system_prompts p ON {_CANON.format('p.id')} = b.canonical GROUP BY b.canonical
        """,
    }
