"""Conversations: building, rendering, prompt modes, label masks and streams of lines cut into articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import strip, valid_article, wiki_title

#: Tokens that a turn pair costs in the chat template beside its text.
CHAT_OVERHEAD = 11
IGNORE = -100
START, END = "<|im_start|>", "<|im_end|>"


def message(role: Column | str, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def conversation(pairs: Column) -> Column:
    """ARRAY<STRUCT<role, content>> of (question, answer) pairs: a user and an assistant turn for each."""
    return F.flatten(F.transform(pairs, lambda p: F.array(message("user", p["question"]), message("assistant", p["answer"]))))


def questions_of(messages: Column) -> Column:
    return F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: m["content"])


def answers_of(messages: Column) -> Column:
    return F.transform(F.filter(messages, lambda m: m["role"] == "assistant"), lambda m: m["content"])


def pairs_of(messages: Column) -> Column:
    """ARRAY<STRUCT<question, answer>>: each user turn with the turn after it, if that is the assistant's."""
    at = F.filter(F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.get(messages, i + 1).alias("next"))), lambda x: (x["role"] == "user") & (x["next"]["role"] == "assistant"))
    return F.transform(at, lambda x: F.struct(x["content"].alias("question"), x["next"]["content"].alias("answer")))


# How the template tells of tools, before and after their signatures, and an empty thinking block.
TOOLS_BEFORE = "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>\n"
TOOLS_AFTER = (
    "\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n"
    '<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'
)
NO_THINKING = "<think>\n\n</think>\n\n"


def render(messages: Column, generation_prompt: bool = False, tools: list[str] | None = None, thinking: bool = True) -> Column:
    """The messages in the chat template; with the opening of an assistant turn after them for generation, and an empty
    thinking block in it if there is to be no thinking. Signatures of ``tools``, as JSON, go into the system message,
    which is made if the messages have none."""
    turn = lambda role, content: F.concat(F.lit(START), role, F.lit("\n"), content, F.lit(END + "\n"))
    each = lambda x: F.array_join(F.transform(x, lambda m: turn(m["role"], F.coalesce(m["content"], F.lit("")))), "")
    if tools:
        block = F.lit(TOOLS_BEFORE + "\n".join(tools) + TOOLS_AFTER)
        led = F.coalesce(F.get(messages, 0)["role"] == "system", F.lit(False))
        own = turn(F.lit("system"), F.concat(F.coalesce(F.get(messages, 0)["content"], F.lit("")), F.lit("\n\n"), block))
        text = F.when(led, F.concat(own, each(F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))))).otherwise(F.concat(turn(F.lit("system"), block), each(messages)))
    else:
        text = each(messages)
    return F.concat(text, F.lit(START + "assistant\n" + ("" if thinking else NO_THINKING))) if generation_prompt else text


def prompt_messages(mode: str, context: Column, question: Column, system: Column | None = None, answer: Column | None = None) -> Column:
    """The messages of a prompt mode: train (system, question, answer), reference (the context before the question),
    question (system and question), bare (the question alone)."""
    sys_ = [message("system", system)] if system is not None else []
    ask = message("user", question)
    if mode == "train":
        return F.array(*sys_, ask, message("assistant", answer if answer is not None else F.lit("")))
    if mode == "reference":
        return F.array(*sys_, message("user", F.concat(context, F.lit("\n\n"), question)))
    if mode == "question":
        return F.array(*sys_, ask)
    if mode == "bare":
        return F.array(ask)
    raise ValueError(f"no mode {mode!r}")


def evaluation_messages(system: Column, history: Column, query: Column, trace: Column) -> Column:
    """System prompt, history, and the query with the trace so far after it."""
    ask = F.when(F.coalesce(trace, F.lit("")) != "", F.concat(query, F.lit("\n"), trace)).otherwise(query)
    return F.concat(F.array(message("system", system)), F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), F.array(message("user", ask)))


def mask_spans(messages: Column) -> Column:
    """ARRAY<STRUCT<role, content, learn>>: learn marks the assistant's turns, the only ones whose tokens are labels."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), (m["role"] == "assistant").alias("learn")))


def mask_labels(ids: Column, start: int, role: int, end: int) -> Column:
    """Labels of token ids: kept from two tokens after each ``start`` ``role`` to one token after the next ``end``, all
    else -100. A span that never ends is kept to the end."""

    def step(s: Column, x: Column) -> Column:
        opened = (s["before"] == start) & (x == role)
        # wait: tokens still to skip before a span is kept; tail: the one token after its end
        wait = F.when(opened, 2).otherwise(F.greatest(s["wait"] - 1, F.lit(0)))
        inside = F.when(opened, F.lit(False)).otherwise(s["inside"] | (s["wait"] == 1))
        keep = inside | s["tail"]
        ends = inside & (x == end)
        return F.struct(
            x.alias("before"), wait.alias("wait"), (inside & ~ends).alias("inside"), ends.alias("tail"), F.concat(s["out"], F.array(F.when(keep, x).otherwise(IGNORE))).alias("out")
        )

    zero = F.struct(F.lit(None).cast("int").alias("before"), F.lit(0).alias("wait"), F.lit(False).alias("inside"), F.lit(False).alias("tail"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(ids, zero, lambda s, x: _same(step(s, x)), lambda s: s["out"])


def _same(s: Column) -> Column:
    return F.struct(s["before"].cast("int").alias("before"), s["wait"].cast("int").alias("wait"), F.coalesce(s["inside"], F.lit(False)).alias("inside"), F.coalesce(s["tail"], F.lit(False)).alias("tail"), s["out"].alias("out"))


def prefix_labels(prompt: Column, rest: Column, length: int, pad: int = 0) -> Column:
    """(ids, labels, mask) of a prompt and what is to be learnt after it: cut to ``length`` and padded on the right;
    the prompt and the padding are -100 in the labels."""
    ids = F.slice(F.concat(prompt, rest), 1, length)
    labels = F.slice(F.concat(F.array_repeat(F.lit(IGNORE), F.size(prompt)), rest), 1, length)
    room = F.lit(length) - F.size(ids)
    fill = lambda v: F.array_repeat(F.lit(v), room)
    return F.struct(F.concat(ids, fill(pad)).alias("ids"), F.concat(labels, fill(IGNORE)).alias("labels"), F.concat(F.array_repeat(F.lit(1), F.size(ids)), fill(0)).alias("mask"))


def suffix_labels(ids: Column, learnt: Column) -> Column:
    """Labels that keep the last ``learnt`` ids and have -100 before them."""
    n = F.least(learnt, F.size(ids))
    return F.concat(F.array_repeat(F.lit(IGNORE), F.size(ids) - n), F.slice(ids, F.size(ids) - n + 1, n))


def padded(ids: Column, length: int, pad: int) -> Column:
    """The first ``length`` ids, padded on the right."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.lit(length) - F.size(cut)))


def collate(df: DataFrame, batch: str, order: str, ids: str, labels: Column, pad: int = 0) -> DataFrame:
    """(batch, ids, labels, mask) of batches of examples, each padded on the right to the longest of its batch, in the
    order of ``order``; labels are padded with -100. A batch is one row, so its size must be bounded."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(ids).alias("i"), labels.alias("l"))))
    g = df.groupBy(batch).agg(rows.alias("r"))
    g = g.withColumn("w", F.array_max(F.transform("r", lambda x: F.size(x["i"]))))
    fill = lambda v, x: F.concat(x, F.array_repeat(F.lit(v), F.col("w") - F.size(x)))
    return g.select(
        batch, F.transform("r", lambda x: fill(pad, x["i"])).alias("ids"), F.transform("r", lambda x: fill(IGNORE, x["l"])).alias("labels"),
        F.transform("r", lambda x: fill(0, F.array_repeat(F.lit(1), F.size(x["i"])))).alias("mask"),
    )


def articles(lines: DataFrame, text: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """(*by, article, title, text) of a stream of lines: a line of equal signs around a title opens an article; what
    stands before the first is dropped, as are articles that aren't valid.

    ``by`` names shards whose lines are streams of their own; without it there is one stream, ordered in one task.
    """
    title = wiki_title(F.col(text))
    keys = by or []
    w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    marked = lines.select(*keys, *[F.col(o) for o in order if o not in keys], F.col(text).alias("_line"), title.alias("_title"))
    cut = marked.withColumn("article", F.count("_title").over(w)).where("article > 0")
    body = F.array_sort(F.collect_list(F.when(F.col("_title").isNull(), F.struct(*order, F.col("_line").alias("line")))))
    g = cut.groupBy(*keys, "article").agg(F.max("_title").alias("title"), strip(F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("text"))
    return g.where(valid_article(F.col("text")))


def turn_replay(messages: Column) -> Column:
    """For each answer the messages that stand before it: ARRAY<STRUCT<turn, prompt, answer>>."""
    at = F.transform(messages, lambda m, i: F.struct(i.alias("i"), m["role"].alias("role"), m["content"].alias("content")))
    answers = F.filter(at, lambda x: x["role"] == "assistant")
    return F.transform(answers, lambda x, k: F.struct(k.alias("turn"), F.slice(messages, F.lit(1), x["i"]).alias("prompt"), x["content"].alias("answer")))
