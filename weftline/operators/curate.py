"""Curation of a distillation set: pairs of responses, similarity filter, joins to examples, splits and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import difficulty_weight, edit_distance, trigram_jaccard
from ..functions.text import is_blank, length_ratio, strip
from .relations import last_wins

EDIT, JACCARD = 0.15, 0.85


def exploded_questions(questions: DataFrame) -> DataFrame:
    """One row for each question, with its defaults: type on_topic, difficulty '', tags none. Repeated rows of a
    prompt give repeated questions."""
    q = questions.select("system_prompt_id", F.explode("questions").alias("q"))
    return q.select(
        "system_prompt_id", F.col("q.id").alias("question_id"), F.col("q.question").alias("question"), F.coalesce("q.type", F.lit("on_topic")).alias("question_type"),
        F.coalesce("q.difficulty", F.lit("")).alias("question_difficulty"), F.coalesce("q.tags", F.array().cast("array<string>")).alias("tags"),
    )


def is_off_topic(question_id: Column, kind: Column) -> Column:
    """The type says so, or the number after the last _q is 11 or more; without a number it isn't."""
    number = F.substring_index(question_id, "_q", -1).try_cast("int")
    return F.coalesce((kind == "off_topic") | F.coalesce(number >= 11, F.lit(False)), F.coalesce(number >= 11, F.lit(False)))


def response_pairs(big: DataFrame, small: DataFrame, pos: str = "loaded_at") -> DataFrame:
    """(question_id, system_prompt_id, answer_big, answer_small) of questions that both models answered; of repeated
    responses the last loaded counts, null answers are empty."""

    def side(df: DataFrame, name: str) -> DataFrame:
        last = last_wins(df.where("question_id is not null").select("question_id", "system_prompt_id", "answer", pos), ["question_id"], F.col(pos))
        return last.select("question_id", F.col("system_prompt_id").alias(f"sp_{name}"), F.coalesce("answer", F.lit("")).alias(f"answer_{name}"))

    return side(big, "big").join(side(small, "small"), "question_id").select("question_id", F.col("sp_big").alias("system_prompt_id"), "answer_big", "answer_small")


def similarity_filter(pairs: DataFrame, types: DataFrame, edit: float = EDIT, jaccard: float = JACCARD) -> DataFrame:
    """(question_id, system_prompt_id, kept, reason, edit_distance, trigram_jaccard, off_topic) of response pairs.

    A pair with a blank answer is dropped with null metrics, even off topic; an off-topic pair is kept; a pair is too
    similar if its edit distance is under and its trigram Jaccard over the thresholds. Metrics have four decimals. The
    texts of blank pairs are null before any metric looks at them. ``types`` has (question_id, question_type), of which
    repeated ones count once, the greatest.
    """
    kinds = types.groupBy("question_id").agg(F.max("question_type").alias("question_type"))
    p = pairs.join(kinds, "question_id", "left").withColumn("off_topic", is_off_topic(F.col("question_id"), F.col("question_type")))
    blank = is_blank(F.col("answer_big")) | is_blank(F.col("answer_small"))
    texts = p.select("question_id", "system_prompt_id", "off_topic", *[F.when(~blank, F.col(c)).alias(c) for c in ("answer_big", "answer_small")])
    # the bytes are few and the work per byte is a hundred times that of a shuffle, so tasks are made by rows, not bytes
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.sparkSession.sparkContext.defaultParallelism)
    texts = texts.repartition(parts, F.xxhash64("question_id", F.lit(1)))
    big, small = F.col("answer_big"), F.col("answer_small")
    m = texts.select("question_id", "system_prompt_id", "off_topic", edit_distance(big, small).alias("e"), trigram_jaccard(big, small).alias("j"))
    reason = F.when(F.col("e").isNull(), "empty_response").when(F.col("off_topic"), "off_topic_preserved").when((F.col("e") < edit) & (F.col("j") > jaccard), "too_similar").otherwise("kept")
    out = m.withColumn("reason", reason)
    return out.select("question_id", "system_prompt_id", F.col("reason").isin("kept", "off_topic_preserved").alias("kept"), "reason", F.round("e", 4).alias("edit_distance"), F.round("j", 4).alias("trigram_jaccard"), "off_topic")


def filter_stats(filtered: DataFrame) -> DataFrame:
    """One row: total, kept, dropped by reason, off-topic kept, and mean metrics of rows that have them (null without)."""
    return filtered.agg(
        F.count("*").alias("total"), F.count_if("kept").alias("kept"), F.count_if(F.col("reason") == "empty_response").alias("empty_response"), F.count_if(F.col("reason") == "too_similar").alias("too_similar"),
        F.count_if(F.col("off_topic") & F.col("kept")).alias("off_topic_kept"), F.round(F.avg("edit_distance"), 4).alias("mean_edit_distance"), F.round(F.avg("trigram_jaccard"), 4).alias("mean_trigram_jaccard"),
    )


def join_examples(kept: DataFrame, questions: DataFrame, prompts: DataFrame, big: DataFrame, small: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """The examples of kept questions: question, prompt and big response must be there, small response and metrics may.

    ``kept`` has question_id. Of repeated prompts the last batch counts, of repeated responses the last loaded, of
    repeated questions the last by their text. Missing metrics are 0.5, a missing category is ''. Kept questions filter
    every other table before its join; sizes decide which joins are broadcast.
    """
    ids = kept.select("question_id").distinct()
    q = last_wins(exploded_questions(questions).where("question_id is not null").join(ids, "question_id", "left_semi"), ["question_id"], F.col("question"))
    sp = last_wins(prompts.where("id is not null").select("id", "system_prompt", "category", "generation_batch"), ["id"], F.col("generation_batch"))

    def last(df: DataFrame) -> DataFrame:
        return last_wins(df.join(ids, "question_id", "left_semi").select("question_id", "answer", "loaded_at"), ["question_id"], F.col("loaded_at")).drop("loaded_at")

    out = q.join(sp, q["system_prompt_id"] == sp["id"]).join(last(big), "question_id").join(last(small).withColumnRenamed("answer", "answer_8b"), "question_id", "left")
    if metrics is not None:
        out = out.join(metrics.select("question_id", "edit_distance", "trigram_jaccard"), "question_id", "left")
    else:
        out = out.withColumn("edit_distance", F.lit(None).cast("double")).withColumn("trigram_jaccard", F.lit(None).cast("double"))
    e, j = F.coalesce("edit_distance", F.lit(0.5)), F.coalesce("trigram_jaccard", F.lit(0.5))
    small_text = F.coalesce("answer_8b", F.lit(""))
    return out.select(
        "question_id", F.col("system_prompt").alias("context"), "question", "answer", small_text.alias("answer_8b"), difficulty_weight(e, j).alias("difficulty_weight"),
        F.struct(e.alias("norm_edit_distance"), j.alias("jaccard_similarity"), F.round(length_ratio(F.coalesce("answer", F.lit("")), small_text), 4).alias("length_ratio")).alias("filter_metrics"),
        "system_prompt_id", F.coalesce("category", F.lit("")).alias("category"), "question_type", "question_difficulty",
    )


def missing_counts(kept: DataFrame, examples: DataFrame) -> DataFrame:
    """One row (kept, joined, missing) of distinct questions."""
    k, e = kept.select("question_id").distinct(), examples.select("question_id").distinct()
    joined = k.join(e.withColumn("hit", F.lit(1)), "question_id", "left")
    return joined.agg(F.count("*").alias("kept"), F.count("hit").alias("joined"), F.count_if(F.col("hit").isNull()).alias("missing"))


def train_without_off_topic(examples: DataFrame) -> DataFrame:
    """Off-topic rows leave the training split; the others keep them."""
    return examples.where(~((F.col("split") == "train") & (F.coalesce("question_type", F.lit("")) == "off_topic")))


def split_stats(examples: DataFrame) -> DataFrame:
    """One row: rows in all and by split, off-topic ones by split, distinct prompts, mean lengths of non-empty texts."""
    of = lambda s: F.col("split") == s
    off = F.coalesce("question_type", F.lit("")) == "off_topic"
    mean = lambda c: F.coalesce(F.round(F.avg(F.when(F.length(c) > 0, F.length(c))), 1), F.lit(0.0))
    return examples.agg(
        F.count("*").alias("total"), *[F.count_if(of(s)).alias(s) for s in ("train", "eval", "test")], *[F.count_if(of(s) & off).alias(f"{s}_off_topic") for s in ("train", "eval", "test")],
        F.count_distinct("system_prompt_id").alias("unique_sps"), mean("context").alias("avg_context_chars"), mean("answer").alias("avg_answer_chars"),
    )


def value_counts(df: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    """(value, n) in the order of values; nulls count as ``missing``."""
    return df.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias("value")).agg(F.count("*").alias("n")).orderBy("value")


def largest_deficit(have: DataFrame, want: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The row (*keys, deficit) of ``want`` (*keys, target, pos) that lacks most in ``have``, the first of equals; no
    row if nothing is lacking."""
    n = have.groupBy(*keys).agg(F.count("*").alias("n"))
    lack = want.join(n, keys, "left").withColumn("deficit", F.col("target") - F.coalesce("n", F.lit(0)))
    return lack.where("deficit > 0").orderBy(F.desc("deficit"), pos).limit(1).select(*keys, "deficit")


def valid_prompt(prompt: Column, domain: Column, category: Column, complexity: Column, want_category: Column, want_complexity: Column) -> Column:
    """A prompt of 20 characters or more, a domain of 2, and the category and complexity that were asked for, without
    regard to case and white space around them; lengths are of stripped texts, nulls are invalid."""
    same = lambda x, y: F.lower(strip(x)) == F.lower(strip(y))
    ok = (F.length(strip(prompt)) >= 20) & (F.length(strip(domain)) >= 2) & same(category, want_category) & same(complexity, want_complexity)
    return F.coalesce(ok, F.lit(False))


# The fields a generated question must have.
QUESTION_FIELDS = ["question", "on_topic", "difficulty", "intent"]


def valid_questions(questions: Column, on: int, off: int) -> Column:
    """Exactly so many on-topic and off-topic questions, each of five characters or more when stripped. A struct always
    has its fields, so difficulty and intent may be null; ``valid_question_json`` asks whether they are there."""
    flag = lambda v: F.size(F.filter(questions, lambda q: q["on_topic"] == v))
    each = F.forall(questions, lambda q: F.length(strip(q["question"])) >= 5)
    return F.coalesce((flag(True) == on) & (flag(False) == off) & (F.size(questions) == on + off) & each, F.lit(False))


def valid_question_json(x: Column, on: int, off: int) -> Column:
    """The same for JSON text of an array: each object must have all of ``QUESTION_FIELDS``, null or not, and its question
    must be a string; false for what is no array of objects."""
    each = F.from_json(x, "array<string>")
    flag = lambda v: F.size(F.filter(each, lambda q: F.get_json_object(q, "$.on_topic") == v))
    keys = F.array(*[F.lit(k) for k in QUESTION_FIELDS])
    whole = lambda q: F.size(F.array_except(keys, F.coalesce(F.json_object_keys(q), F.array().cast("array<string>")))) == 0
    text = lambda q: F.try_variant_get(F.try_parse_json(q), "$.question", "string")
    string = lambda q: F.schema_of_variant(F.try_variant_get(F.try_parse_json(q), "$.question", "variant")) == "STRING"
    good = F.forall(each, lambda q: F.coalesce(whole(q) & string(q) & (F.length(strip(text(q))) >= 5), F.lit(False)))
    return F.coalesce((flag("true") == on) & (flag("false") == off) & (F.size(each) == on + off) & good, F.lit(False))


def cost_estimate(df: DataFrame, input_price: float = 0.2, output_price: float = 0.6) -> DataFrame:
    """One row (items, input_tokens, output_tokens, cost): prices are for a million tokens, nulls cost nothing."""
    t = df.agg(F.count("*").alias("items"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
    return t.withColumn("cost", F.round((F.col("input_tokens") * input_price + F.col("output_tokens") * output_price) / 1_000_000, 6))
