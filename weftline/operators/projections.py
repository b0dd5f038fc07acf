"""Projections of source records onto what training and evaluation read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import capitalize_first, strip
from .chat import conversation, message

#: What a row of results holds beside the answers of methods.
NO_METHODS = ["id", "system_prompt", "conversation_history", "user_query", "partial_trace", "expected_output"]


def span_question(df: DataFrame, context: str, question: str, answers: str) -> DataFrame:
    """(context, question, answers), all stripped; an answer that begins with a small letter gets a capital."""
    up = F.transform(F.col(answers), lambda a: capitalize_first(strip(a), only_lower=True))
    return df.select(strip(F.col(context)).alias("context"), strip(F.col(question)).alias("question"), up.alias("answers"))


def dialogue_projection(df: DataFrame, context: str, qas: str) -> DataFrame:
    """(evidence, conversations, questions, answers) of (question, answer) pairs; the arrays go in parallel."""
    c = F.col(qas)
    return df.select(F.col(context).alias("evidence"), conversation(c).alias("conversations"), F.transform(c, lambda x: x["question"]).alias("questions"), F.transform(c, lambda x: x["answer"]).alias("answers"))


def variants(df: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
    """One row (*keep, variant, conversation) for each of several columns of the same type, in place of as many columns;
    variant is the column's place from 0. Null ones stay."""
    each = F.posexplode(F.array(*[F.col(n) for n in names])).alias("variant", "conversation")
    return df.select(*keep, each)


def distill_rows(df: DataFrame, default_weight: float = 1.0) -> DataFrame:
    """(system_prompt, question, answer, difficulty_weight) of examples; a missing weight has the default."""
    return df.select(F.col("context").alias("system_prompt"), "question", "answer", F.coalesce("difficulty_weight", F.lit(default_weight)).alias("difficulty_weight"))


def adversarial_rows(df: DataFrame, pos: str, default_weight: float = 3.0) -> DataFrame:
    """Hand-written cases with what is missing filled in: ids from the position, from 0, the question and answers of
    the small model, the category, the type, the weight."""
    has = lambda c, v: F.coalesce(F.col(c), v).alias(c) if c in df.columns else v.alias(c)
    n = F.col(pos) + 1
    return df.select(
        has("question_id", F.format_string("adv_%03d", n)), has("system_prompt_id", F.format_string("sp_ADV%02d", n)), has("category", F.lit("adversarial")), has("question_type", F.lit("on_topic")),
        has("difficulty_weight", F.lit(default_weight)), "context", "question", has("teacher_answer", F.lit("")), has("answer_8b", F.lit("")), has("notes", F.lit("")),
    )


def messages_with_context(context: Column, question: Column) -> Column:
    """The system prompt and the question as messages."""
    return F.array(message("system", context), message("user", question))


def method_texts(results: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, method, text) of results as JSON text: every field that isn't one of ``NO_METHODS`` is a method, its text
    under response.answer, else under answer, else the field itself if it is a string; others are left out."""
    fields = F.explode(F.try_variant_get(F.try_parse_json(raw), "$", "map<string,variant>")).alias("method", "v")
    v = F.col("v")
    kind = F.schema_of_variant(v)
    text = F.when(F.try_variant_get(v, "$.response", "variant").isNotNull(), F.coalesce(F.try_variant_get(v, "$.response.answer", "string"), F.lit(""))).otherwise(
        F.coalesce(F.try_variant_get(v, "$.answer", "string"), F.when(kind == "STRING", F.try_variant_get(v, "$", "string")))
    )
    return results.select(key, fields).where(~F.col("method").isin(NO_METHODS)).select(key, "method", text.alias("text")).where("text is not null")


def work_items(questions: DataFrame, prompts: DataFrame) -> DataFrame:
    """(question_id, system_prompt_id, system_prompt, question) of exploded questions whose prompt is there; of
    repeated prompts the last batch counts."""
    last = prompts.groupBy("id").agg(F.max_by("system_prompt", "generation_batch").alias("system_prompt"))
    return questions.join(last, questions["system_prompt_id"] == last["id"]).select("question_id", "system_prompt_id", "system_prompt", "question")


def human_projection(df: DataFrame, context: str, questions: str, keep: list[str] | None = None) -> DataFrame:
    """(*keep, evidence, questions) of contexts with an array of questions that people asked."""
    return df.select(*(keep or []), F.col(context).alias("evidence"), F.col(questions).alias("questions"))


def group_members(groups: DataFrame, key: str) -> DataFrame:
    """(key, group_id, n, first): to each row the size of its group and the group's least key. Members are rows with the
    same group_id, so a group of n rows costs n rows, however large it is; ``grouping.group_contexts`` puts the texts
    of a group together once."""
    held = groups.groupBy("group_id").agg(F.count("*").alias("n"), F.min(key).alias("first"))
    return groups.join(held, "group_id").select(key, "group_id", "n", "first")
