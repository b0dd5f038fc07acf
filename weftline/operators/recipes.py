"""The recipes of twenty-two public corpora: each takes the corpus as delivered, with a column ``pos`` that orders its
rows, and gives (context, conversations); ``build`` also counts lengths and writes capitals.

Shapes and gates are functions of ``corpus``; a recipe only says which of them a corpus goes through. Rows without a
context, and single questions without an answer, are left out. Where turns are shuffled, or contexts joined with others,
a seeded order of ``pos`` decides, which must be unique.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import approx_tokens, strip
from . import corpus

LETTERS = "ABCD"


def _single(df: DataFrame, context: Column, question: Column, answer: Column, num: int = 1, only_distinct: bool = False, seed: int = 0) -> DataFrame:
    """One question with one answer a row; with ``num``, the context joined with those of num - 1 other rows, or of
    other distinct contexts."""
    rows = df.select("pos", context.alias("context"), question.alias("question"), answer.alias("answer")).where("context is not null and answer is not null")
    if num > 1:
        rows = corpus.with_other_contexts(rows, "context", num, "pos", seed, only_distinct)
    return corpus.qa_to_conversation(rows)


def marco(df: DataFrame, num: int = 2, seed: int = 0) -> DataFrame:
    """passages(is_selected, passage_text), query, answers: queries with a selected passage and an answer."""
    picked = corpus.selected_passages(df, keep=["pos"])
    return _single(picked, F.col("context"), F.col("question"), F.col("answer"), num, seed=seed)


def first_of(df: DataFrame, context: str, answers: Column, num: int = 1, only_distinct: bool = False, seed: int = 0) -> DataFrame:
    """The first of a row's answers, all texts stripped."""
    return _single(df, strip(F.col(context)), strip(F.col("question")), strip(F.get(answers, 0)), num, only_distinct, seed)


def letter_choice(options: Column, letter: Column) -> Column:
    """The option that one of A to D names, stripped; null for other letters."""
    at = F.instr(F.lit(LETTERS), letter) - 1
    return F.when((F.length(letter) == 1) & (at >= 0), strip(F.get(options, at)))


def race(df: DataFrame, num: int = 4, seed: int = 0) -> DataFrame:
    return _single(df, strip(F.col("article")), strip(F.col("question")), letter_choice(F.col("options"), F.col("answer")), num, True, seed)


def paragraphs_of_sentences(df: DataFrame, between: str, num: int = 1, seed: int = 0) -> DataFrame:
    """context.sentences: an array of paragraphs, each an array of sentences joined by ``between``."""
    text = F.array_join(F.transform(F.col("context.sentences"), lambda p: F.array_join(p, between)), "\n\n")
    return _single(df, text, F.col("question"), F.col("answer"), num, seed=seed)


def musique(df: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("paragraphs", lambda p: p["paragraph_text"]), "\n\n")
    return _single(df, text, strip(F.col("question")), strip(F.col("answer")))


def ready_pairs(*parts: DataFrame) -> DataFrame:
    """Splits of a corpus whose conversations are pairs of question and answer already."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return corpus.pairs_to_conversation(rows.where("context is not null").withColumnRenamed("conversations", "qa_pairs"), "qa_pairs")


def quac(df: DataFrame) -> DataFrame:
    """title, background, context and qas(question, orig_answer.text); turns that can't be answered are dropped, a
    dialogue that loses all stays."""
    pairs = F.transform("qas", lambda q: F.struct(q["question"].alias("question"), q["orig_answer"]["text"].alias("answer")))
    return corpus.filtered_dialogues(df.where("context is not null").withColumn("qas", pairs), ["title", "background", "context"], "qas")


def zipped(df: DataFrame, context: str, questions: str, answers: Column, trim: bool = False) -> DataFrame:
    rows = df.where(F.col(context).isNotNull()).select(F.col(context).alias("context"), F.col(questions).alias("q"), answers.alias("a"))
    return corpus.zipped_turns(rows, "context", "q", "a", trim)


def grouped(df: DataFrame, context: str, question: str, answer: Column, strip_turns: bool = False, **gates) -> DataFrame:
    """Questions of the same context together (``corpus.grouped_recipe`` and its gates)."""
    clean = strip if strip_turns else lambda x: x
    rows = df.select("pos", F.col(context).alias("context"), clean(F.col(question)).alias("question"), clean(answer).alias("answer"))
    return corpus.grouped_recipe(rows, "context", "question", "answer", "pos", **gates)


def _at(options: str, number: str) -> Column:
    return F.get(F.col(options), F.col(number))


_LONG = {"max_context": corpus.MAX_CONTEXT}

#: corpus -> recipe
RECIPES: dict[str, Callable[..., DataFrame]] = {
    "ms_marco_v1": marco,
    "ms_marco_v2": marco,
    "squad": lambda df, seed=0: first_of(df, "context", F.col("answers.text"), 10, True, seed),
    "race": race,
    "duorc_self": lambda df, seed=0: first_of(df, "plot", F.col("answers"), 2, seed=seed),
    "duorc_paraphrase": lambda df: first_of(df, "plot", F.col("answers")),
    "hotpotqa": partial(paragraphs_of_sentences, between=""),
    "musique": musique,
    "2wiki": partial(paragraphs_of_sentences, between=" ", num=2),
    "ms_marco_mqa": ready_pairs,
    "ms_marco_v2_mqa": ready_pairs,
    "quac": quac,
    "coqa": lambda df: zipped(df, "story", "questions", F.col("answers.input_text")),
    "drop": lambda df: grouped(df, "passage", "question", F.get("answers_spans.spans", 0), trim=False),
    "narrativeqa": lambda df: grouped(df.withColumn("_c", F.col("document.summary.text")).withColumn("_q", F.col("question.text")), "_c", "_q", F.get("answers", 0)["text"], trim=False, trim_to=corpus.MAX_TOTAL, **_LONG),
    "quail": lambda df: grouped(df, "context", "question", _at("answers", "correct_answer_id"), trim=False, sentinel="not enough information", max_total=corpus.MAX_TOTAL, **_LONG),
    "pwc": lambda df: grouped(df, "input", "prompt", F.col("answer"), trim=False, max_turn=corpus.MAX_TURN, trim_to=corpus.MAX_TOTAL, **_LONG),
    "squad_mqa": lambda df, seed=0: grouped(df, "context", "question", F.get("answers.text", 0), True, seed=seed),
    "race_mqa": lambda df, seed=0: grouped(df, "article", "question", letter_choice(F.col("options"), F.col("answer")), True, seed=seed),
    "newsqa": lambda df: zipped(df, "paragraph", "questions", F.col("answers"), trim=True),
    "duorc_self_mqa": lambda df: grouped(df, "plot", "question", F.get("answers", 0), True, unanswered=False),
    "duorc_paraphrase_mqa": lambda df: grouped(df, "plot", "question", F.get("answers", 0), True, unanswered=False),
}


def build(name: str, *tables: DataFrame, tok: Callable[[Column], Column] = approx_tokens, **params) -> DataFrame:
    """(dataset, contextlen, conversationlen, context, conversations) of a corpus by its recipe."""
    return corpus.finish(RECIPES[name](*tables, **params), tok, name)
