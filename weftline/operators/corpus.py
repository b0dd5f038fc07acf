"""Corpus recipes: heterogeneous question-answering sources into {context, conversations}.

Twenty-two public corpora come in a few shapes; each shape is one function here, and ``recipes`` says which shape and
parameters a corpus has. All give ``context`` and ``conversations`` (an array of (role, content)) or, for single
questions, one question with one answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import capitalize_first, strip, word_count
from .chat import conversation
from .relations import ranked, seeded

MAX_CONTEXT, MAX_TOTAL, MAX_TURN = 2048, 512, 128


def selected_passages(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(*keep, context, question, answer) of passages(is_selected, passage_text), query and answers: rows with a selected
    passage and an answer; all passages joined by blank lines, the first answer."""
    some = F.aggregate("passages.is_selected", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)).cast("long")) > 0
    kept = df.where(some & (F.size("answers") > 0))
    return kept.select(*(keep or []), F.array_join("passages.passage_text", "\n\n").alias("context"), F.col("query").alias("question"), F.element_at("answers", 1).alias("answer"))


def lettered_choice(df: DataFrame, context: str, question: str, options: str, letter: str) -> DataFrame:
    """(context, question, answer): the option that a letter A, B, C ... names; null for other letters."""
    at = F.ascii(F.col(letter)) - F.lit(ord("A"))
    return df.select(strip(F.col(context)).alias("context"), F.col(question).alias("question"), F.get(F.col(options), at).alias("answer"))


def nested_sentences(df: DataFrame, sentences: str, question: str, answer: str, between: str = "", keep: list[str] | None = None) -> DataFrame:
    """(*keep, context, question, answer) of paragraphs that are arrays of sentences, joined by ``between``; paragraphs are
    joined by blank lines."""
    paragraphs = F.transform(F.col(sentences), lambda p: F.array_join(p, between))
    return df.select(*(keep or []), F.array_join(paragraphs, "\n\n").alias("context"), F.col(question).alias("question"), F.col(answer).alias("answer"))


def joined_paragraphs(df: DataFrame, paragraphs: str, question: str, answer: str, aliases: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """(*keep, context, question, answers) of paragraphs with paragraph_text; answers are the answer and its aliases, all
    stripped."""
    text = F.array_join(F.transform(F.col(paragraphs), lambda p: p["paragraph_text"]), "\n\n")
    more = F.transform(F.coalesce(F.col(aliases), F.array().cast("array<string>")), strip) if aliases else F.array().cast("array<string>")
    return df.select(*(keep or []), text.alias("context"), F.col(question).alias("question"), F.concat(F.array(strip(F.col(answer))), more).alias("answers"))


def zipped_turns(df: DataFrame, context: str, questions: str, answers: str, trim: bool = False) -> DataFrame:
    """(context, conversations): questions with answers in order, as many as the shorter array has."""
    n = F.least(F.size(questions), F.size(answers))
    t = strip if trim else lambda x: x
    pairs = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(t(F.get(F.col(questions), i - 1)).alias("question"), t(F.get(F.col(answers), i - 1)).alias("answer"))))
    empty = F.array().cast("array<struct<question:string,answer:string>>")
    return df.select(F.col(context).alias("context"), conversation(F.coalesce(pairs, empty)).alias("conversations"))


def filtered_dialogues(df: DataFrame, contexts: list[str], qas: str, sentinel: str = "CANNOTANSWER") -> DataFrame:
    """(context, conversations) of dialogues: the context columns joined by blank lines, turns with the sentinel answer
    dropped; a dialogue without turns left stays, with an empty conversation."""
    kept = F.filter(F.col(qas), lambda q: F.coalesce(q["answer"] != sentinel, F.lit(True)))
    return df.select(F.concat_ws("\n\n", *contexts).alias("context"), conversation(kept).alias("conversations"))


def grouped_by_text(df: DataFrame, context: str, question: str, answer: str, pos: str, trim: bool = True, sentinel: str | None = None, seed: int | None = None) -> DataFrame:
    """(context, first_pos, pairs): questions and answers of the same context together, in the order of ``pos`` or of a
    seed; contexts are grouped by their hash, null ones left out, and a sentinel answer drops its turn, so a context
    that loses all turns has no row.

    A group's pairs are one value, as in any nested table; the hash keeps the shuffle key small. ``grouped_parts`` is
    for contexts with more turns than one value should hold.
    """
    text = strip(F.col(context)) if trim else F.col(context)
    rows = df.select(text.alias("context"), F.col(question).alias("question"), F.col(answer).alias("answer"), F.col(pos).alias("pos")).where("context is not null")
    if sentinel is not None:
        rows = rows.where(F.coalesce(F.col("answer") != sentinel, F.lit(True)))
    order = F.col("pos") if seed is None else seeded(F.col("pos"), seed)
    items = F.array_sort(F.collect_list(F.struct(order.alias("k"), F.col("pos"), F.struct("question", "answer").alias("pair"))))
    g = rows.groupBy(F.sha2("context", 256).alias("h")).agg(F.first("context").alias("context"), F.min("pos").alias("first_pos"), F.transform(items, lambda x: x["pair"]).alias("pairs"))
    return g.drop("h")


def grouped_parts(df: DataFrame, context: str, question: str, answer: str, pos: str, size: int = 1000) -> DataFrame:
    """(h, part, pairs): the same groups in parts of at most ``size`` pairs, for contexts that have very many.

    h is the hash of the stripped context; parts are numbered in the order of ``pos``, which must be unique, not from 0 and
    not without gaps. Rows are range-partitioned by context and place, so a context with a third of all rows is spread
    over tasks like any others. Runs a job when called.
    """
    rows = df.select(F.sha2(strip(F.col(context)), 256).alias("h"), F.col(pos).alias("pos"), F.struct(F.col(question).alias("question"), F.col(answer).alias("answer")).alias("pair")).where("h is not null")
    placed = ranked(rows, F.struct("h", "pos"), "place")
    g = placed.groupBy("h", F.floor(F.col("place") / size).alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", "pair"))).alias("x"))
    return g.select("h", "part", F.transform("x", lambda x: x["pair"]).alias("pairs"))


def words_of_pairs(pairs: Column) -> Column:
    """How many words questions and answers have together."""
    return F.aggregate(pairs, F.lit(0), lambda n, p: n + word_count(p["question"]) + word_count(p["answer"]))


def trim_to_words(pairs: Column, most: int = MAX_TOTAL) -> Column:
    """The longest run of first pairs with at most so many words in all: turns are cut from the end."""
    none = F.array().cast("array<struct<question:string,answer:string>>")
    start = F.struct(F.lit(0).alias("n"), none.alias("kept"))

    def step(s: Column, p: Column) -> Column:
        n = s["n"] + word_count(p["question"]) + word_count(p["answer"])
        return F.struct(n.alias("n"), F.when(n <= most, F.concat(s["kept"], F.array(F.struct(p["question"].alias("question"), p["answer"].alias("answer"))))).otherwise(s["kept"]).alias("kept"))

    return F.aggregate(pairs, start, step, lambda s: s["kept"])


def trim_rows_to_words(df: DataFrame, group: list[str], pos: str, words: Column, most: int = MAX_TOTAL) -> DataFrame:
    """The same on rows, by a running sum: the first rows of each group with at most so many words in all."""
    w = W.partitionBy(*group).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("_n", F.sum(words).over(w)).where(F.col("_n") <= most).drop("_n")


def drop_long_turns(pairs: Column, most: int = MAX_TURN) -> Column:
    """The pairs whose question and answer each have at most so many words."""
    return F.filter(pairs, lambda p: (word_count(p["question"]) <= most) & (word_count(p["answer"]) <= most))


def with_other_contexts(df: DataFrame, context: str, num: int, pos: str, seed: int = 0, only_distinct: bool = False) -> DataFrame:
    """Each row's context joined by blank lines with those of num - 1 other rows, in a seeded order.

    A row's partners are the rows that follow it, cyclically, in a seeded order of all; with ``only_distinct`` of
    distinct contexts. With fewer than num contexts each is used once. Places in the order are range-partitioned ranks:
    the sort is spread over tasks, and partners are found by an equi join on places.
    """
    base = df.select(F.col(context).alias("c"), F.col(pos).alias("p"))
    if only_distinct:
        base = base.groupBy(F.sha2("c", 256).alias("h")).agg(F.first("c").alias("c"), F.min("p").alias("p")).drop("h")
    n = base.count()
    if n == 0 or num <= 1:
        return df
    placed = ranked(base, seeded(F.col("p"), seed), "place")
    offsets = F.explode(F.array(*[F.lit(i) for i in range(min(num, n))]))
    want = placed.select(F.col("p").alias("_p"), F.col("c").alias("_own"), "place", offsets.alias("off")).withColumn("at", F.pmod(F.col("place") + F.col("off"), F.lit(n)))
    found = want.join(placed.select(F.col("place").alias("at"), F.col("c").alias("part")), "at")
    joined = found.groupBy("_p").agg(F.first("_own").alias("_own"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seeded(F.concat_ws("/", "_p", "off"), seed).alias("k"), F.col("part")))), lambda x: x["part"]), "\n\n").alias("_ctx"))
    if only_distinct:
        return df.join(joined.drop("_p"), F.sha2(df[context], 256) == F.sha2("_own", 256), "left").withColumn(context, F.coalesce("_ctx", F.col(context))).select(*df.columns)
    return df.join(joined.drop("_own"), df[pos] == F.col("_p"), "left").withColumn(context, F.coalesce("_ctx", F.col(context))).select(*df.columns)


def finish(df: DataFrame, tok: Callable[[Column], Column], dataset: str | None = None) -> DataFrame:
    """(dataset, contextlen, conversationlen, context, conversations): lengths by ``tok``, taken before the first
    letters of the assistant's turns become capitals."""
    from .chat import CHAT_OVERHEAD

    turns = F.aggregate("conversations", F.lit(0).cast("long"), lambda n, m: n + tok(m["content"]).cast("long"))
    sized = df.select(
        F.lit(dataset).alias("dataset"), tok(F.col("context")).cast("int").alias("contextlen"), (turns + F.ceil(F.size("conversations") / 2) * CHAT_OVERHEAD).cast("int").alias("conversationlen"), "context", "conversations"
    )
    up = F.transform("conversations", lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "assistant", capitalize_first(m["content"])).otherwise(m["content"]).alias("content")))
    return sized.withColumn("conversations", up)


def length_gate(df: DataFrame, context: int, conversation_: int) -> DataFrame:
    return df.where((F.col("contextlen") <= context) & (F.col("conversationlen") <= conversation_))


def qa_to_conversation(df: DataFrame) -> DataFrame:
    """(context, conversations) of (context, question, answer): one user and one assistant turn."""
    return df.select("context", conversation(F.array(F.struct("question", "answer"))).alias("conversations"))


def pairs_to_conversation(df: DataFrame, pairs: str = "pairs") -> DataFrame:
    return df.select("context", conversation(F.col(pairs)).alias("conversations"))


def grouped_recipe(
    df: DataFrame, context: str, question: str, answer: str, pos: str, *, trim: bool = True, sentinel: str | None = None, seed: int | None = None,
    max_context: int | None = None, trim_to: int | None = None, max_total: int | None = None, max_turn: int | None = None, unanswered: bool = True,
) -> DataFrame:
    """(context, conversations) of a grouped corpus with its gates, in the order: unanswered turns, grouping, long
    contexts, long turns, trimming from the end, whole items that are too long. Trimming may leave a conversation
    empty; it stays."""
    rows = df if unanswered else df.where(F.col(answer).isNotNull())
    g = grouped_by_text(rows, context, question, answer, pos, trim, sentinel, seed)
    if max_context is not None:
        g = g.where(word_count(F.col("context")) <= max_context)
    if max_turn is not None:
        g = g.withColumn("pairs", drop_long_turns(F.col("pairs"), max_turn))
    if trim_to is not None:
        g = g.withColumn("pairs", trim_to_words(F.col("pairs"), trim_to))
    if max_total is not None:
        g = g.where(words_of_pairs(F.col("pairs")) <= max_total)
    return pairs_to_conversation(g)
