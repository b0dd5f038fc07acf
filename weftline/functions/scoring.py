"""Column functions that score answers: exact match, token F1, similarity, think blocks, tool calls."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import answer_tokens, let, let2, normalize_answer, strip

# --- answers ---


def exact_match(gold: Column, said: Column) -> Column:
    """1 if both are the same after ``normalize_answer``, else 0; null as an empty text."""
    norm = lambda x: normalize_answer(F.coalesce(x, F.lit("")))
    return (norm(gold) == norm(said)).cast("int")


def numbered(x: Column) -> Column:
    """The elements of an array of texts, each with the number of its occurrence after it, so that sets of them compare as
    bags. Sorting brings equal ones together; where each run begins gives the numbers, in linear time."""

    def from_runs(v: Column) -> Column:
        s, at = v["s"], v["at"]
        run = lambda p, j: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(at, j + 1), F.size(s)) - p), lambda k: F.concat(F.get(s, p), F.lit(" "), k.cast("string")))
        return F.flatten(F.transform(at, run))

    def begins(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(F.struct(s.alias("s"), first.alias("at")), from_runs)

    return F.when(F.size(x) > 0, let(F.array_sort(x), begins)).otherwise(F.array().cast("array<string>"))


def bag_overlap(a: Column, b: Column) -> Column:
    """How many elements two arrays of texts share, each as often as it stands in both."""
    return F.size(F.array_intersect(numbered(a), numbered(b)))


def harmonic(common: Column, a: Column, b: Column) -> Column:
    """F1 of a number in common and two sizes; 0 without any in common."""
    return F.when(common == 0, F.lit(0.0)).otherwise(2.0 * common / (a + b))


def token_f1(gold: Column, said: Column) -> Column:
    """Token F1; if either side has no words, 1 if neither has, else 0."""

    def f1(g: Column, p: Column) -> Column:
        return F.when((F.size(g) == 0) | (F.size(p) == 0), (F.size(g) == F.size(p)).cast("double")).otherwise(_f1(g, p))

    return let2(answer_tokens(gold), answer_tokens(said), f1)


def _f1(g: Column, p: Column) -> Column:
    return let(bag_overlap(g, p), lambda common: harmonic(common, F.size(g), F.size(p)))


def strict_f1(gold: Column, said: Column) -> Column:
    """Token F1 for multi-hop answers: yes, no and noanswer must be met exactly, and two empty sides have 0."""

    def f1(g: Column, p: Column) -> Column:
        one = lambda x: (F.size(x) == 1) & F.get(x, 0).isin("yes", "no", "noanswer")
        return F.when((one(g) | one(p)) & (g != p), F.lit(0.0)).otherwise(_f1(g, p))

    return let2(answer_tokens(gold), answer_tokens(said), f1)


def token_f1_rows(df: DataFrame, key: str, gold: str, said: str) -> DataFrame:
    """(key, f1) for long texts: the same as ``token_f1``, with words as rows, counted and joined, in place of arrays
    compared within a row. Keys must be unique."""
    base = df.select(F.col(key), answer_tokens(F.col(gold)).alias("g"), answer_tokens(F.col(said)).alias("p"))

    def counts(side: str, name: str) -> DataFrame:
        return base.select(key, F.explode(side).alias("w")).groupBy(key, "w").agg(F.count("*").alias(name))

    common = counts("g", "ng").join(counts("p", "np"), [key, "w"]).groupBy(key).agg(F.sum(F.least("ng", "np")).alias("common"))
    sizes = base.select(key, F.size("g").alias("g"), F.size("p").alias("p")).join(common, key, "left")
    n = F.coalesce("common", F.lit(0))
    return sizes.select(key, F.when((F.col("g") == 0) | (F.col("p") == 0), (F.col("g") == F.col("p")).cast("double")).otherwise(harmonic(n, F.col("g"), F.col("p"))).alias("f1"))


def best_over(golds: Column, said: Column, metric) -> Column:
    """The highest metric over an array of golds, not under 0; 0 without golds."""
    return F.coalesce(F.array_max(F.transform(golds, lambda g: F.coalesce(metric(g, said).cast("double"), F.lit(0.0)))), F.lit(0.0))


def answer_list(truth: Column) -> Column:
    """An array of golds from VARIANT: a string, an array of strings or of objects with text (else answer), an object
    with text or answers.text; null gives one empty gold, and whatever else its text."""
    kind = F.schema_of_variant(truth)
    array = F.try_variant_get(truth, "$", "array<variant>")

    def one(v: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, "$.text", "string"), F.try_variant_get(v, "$.answer", "string"), F.try_variant_get(v, "$", "string"))

    inner = F.when(F.try_variant_get(truth, "$.text", "variant").isNotNull(), F.coalesce(F.try_variant_get(truth, "$.text", "array<string>"), F.array(F.try_variant_get(truth, "$.text", "string")))).when(
        F.try_variant_get(truth, "$.answers.text", "variant").isNotNull(), F.try_variant_get(truth, "$.answers.text", "array<string>")
    )
    found = F.when(F.startswith(kind, F.lit("ARRAY")), F.transform(array, one)).when(F.startswith(kind, F.lit("OBJECT")), inner)
    whole = F.array(F.coalesce(F.try_variant_get(truth, "$", "string"), F.lit("")))
    return F.when(F.size(F.coalesce(found, F.array())) > 0, found).otherwise(whole)


def fact_scores(said: Column, gold: Column) -> Column:
    """(precision, recall, f1, em) of two sets of facts; repeated facts count once."""
    return let2(F.array_distinct(said), F.array_distinct(gold), _fact_scores)


def _fact_scores(p: Column, g: Column) -> Column:
    tp = F.size(F.array_intersect(p, g))
    zero = lambda n, d: F.when(d > 0, n / d).otherwise(F.lit(0.0))
    return F.struct(
        zero(tp, F.size(p)).alias("precision"), zero(tp, F.size(g)).alias("recall"), zero(2.0 * tp, F.when(tp > 0, F.size(p) + F.size(g)).otherwise(F.lit(0))).alias("f1"),
        ((tp == F.size(p)) & (tp == F.size(g))).cast("double").alias("em"),
    )


# --- similarity of two responses ---


@F.pandas_udf(DoubleType())
def _sequence_distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([None if x is None or y is None else 0.0 if not x and not y else 1.0 - SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def edit_distance(a: Column, b: Column) -> Column:
    """One less the share of matching blocks that difflib finds, of both texts; not Levenshtein, and not symmetric.
    The one function here that leaves the JVM, in Arrow batches: no built-in finds longest matching blocks."""
    return _sequence_distance(a, b)


def _runs_of_three(x: Column) -> Column:
    """The runs of three characters, repeated ones too, in linear time: a pattern finds them where each character is one
    unit of UTF-16, else the text is cut into characters first."""

    def cut(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(c) - 2), lambda i: F.concat(F.get(c, i - 1), F.get(c, i), F.get(c, i + 1)))

    one_unit = F.octet_length(F.encode(x, "UTF-16BE")) == 2 * F.length(x)
    found = F.when(one_unit, F.regexp_extract_all(x, F.lit("(?s)(?=(...))"), F.lit(1))).otherwise(let(F.filter(F.split(x, ""), lambda c: c != ""), cut))
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).when(F.length(x) < 3, F.array(x)).otherwise(found)


def char_trigrams(x: Column) -> Column:
    """The distinct runs of three characters; a shorter text is its own, an empty one has none."""
    return F.array_distinct(_runs_of_three(x))


def trigram_jaccard(a: Column, b: Column) -> Column:
    """The share of trigrams in common; 1 for two empty texts, 0 for one."""

    def share(x: Column, y: Column) -> Column:
        return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))

    return let2(_runs_of_three(a), _runs_of_three(b), share)


def difficulty_weight(edit: Column, jaccard: Column) -> Column:
    """From 0.5, both responses the same, to 2.0, nothing in common; four decimals; a missing metric is 0.5."""
    e, j = F.coalesce(edit, F.lit(0.5)), F.coalesce(jaccard, F.lit(0.5))
    return F.round(0.5 + 1.5 * (0.6 * e + 0.4 * (1 - j)), 4)


# --- think blocks ---

_OPEN, _CLOSE = "<think>", "</think>"


def _answer_label(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?i)^(final answer|answer)\s*:\s*", ""))


def _first_line(x: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.transform(F.split(x, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"), strip), lambda s: s != ""), 0), x)


def _result(think: Column, answer: Column) -> Column:
    return F.struct(think.alias("think"), answer.alias("answer"))


def split_think(x: Column, variant: str = "responses") -> Column:
    """(think, answer) of a raw response. The variants differ where tags are missing, reversed or in capitals:

    responses: any case; an open block has no think part and the answer after its tag; else malformed is [error].
    qa: any case; malformed has no think part; full blocks and an answer label are removed; the first line counts.
    turns: any case; one tag alone or reversed is [error] and the raw text, unless it begins with an open tag and a
      line end, after which all is the answer; label and first line as in qa.
    plain: exact case; an open block is all think; label removed, all lines kept.
    tools: as plain, with the label kept.
    """
    low = F.lower(x)
    if variant in ("plain", "tools"):
        start = F.instr(x, _OPEN)
        rest = F.substring(x, start + len(_OPEN), F.length(x))
        end = F.instr(rest, _CLOSE)
        think = F.when(start == 0, "").when(end > 0, strip(F.substring(rest, F.lit(1), end - 1))).otherwise(strip(rest))
        answer = F.when(start == 0, strip(x)).when(end > 0, strip(F.substring(rest, end + len(_CLOSE), F.length(x)))).otherwise("")
        return _result(think, _answer_label(answer) if variant == "plain" else answer)
    start, end = F.instr(low, _OPEN), F.instr(low, _CLOSE)
    inside = strip(F.substring(x, start + len(_OPEN), end - start - len(_OPEN)))
    after = strip(F.substring(x, end + len(_CLOSE), F.length(x)))
    good = (start > 0) & (end > start)
    if variant == "responses":
        neither, open_only = (start == 0) & (end == 0), (start > 0) & (end == 0)
        think = F.when(neither | open_only, "").when(good, inside).otherwise("[error]")
        answer = F.when(neither, strip(x)).when(open_only, strip(F.substring(x, start + len(_OPEN), F.length(x)))).when(good, after).otherwise(x)
        return _result(think, answer)
    if variant == "qa":
        bare = strip(F.regexp_replace(x, r"(?is)<think>.*?</think>\s*", ""))
        return _result(F.when(good, inside).otherwise(""), _first_line(_answer_label(F.when(good, after).otherwise(bare))))
    if variant == "turns":
        one = (start > 0) != (end > 0)
        led = one & F.startswith(x, F.lit("<think>\n"))
        wrong = one | ((start > 0) & (end < start))
        think = F.when(led, "").when(wrong, "[error]").when(good, inside).otherwise("")
        fine = _first_line(_answer_label(F.when(good, after).otherwise(strip(x))))
        return _result(think, F.when(led, strip(F.substring(x, 9, 1 << 30))).when(wrong, x).otherwise(fine))
    raise ValueError(f"no variant {variant!r}")


# --- tool calls ---


def parse_tool_call(x: Column) -> Column:
    """(thought_yes, action, action_input, ai_response) of a reply; each the first that is found, null without."""

    def first(p: str) -> Column:
        return F.nullif(strip(F.regexp_extract(x, p, 1)), F.lit(""))

    yes = F.lower(first(r"(?i)Thought:\s*Do I need to use a tool\?\s*(Yes|No)"))
    return F.struct(
        (yes == "yes").alias("thought_yes"), first(r"Action:\s*(.+?)(?:\n|$)").alias("action"), first(r"Action Input:\s*(.+?)(?:\n|$)").alias("action_input"), first(r"(?s)AI:\s*(.+?)(?:\n|\z)").alias("ai_response")
    )


def tool_scores(expected: Column, said: Column) -> Column:
    """(thought, action, args, full): what of an expected tool call a reply meets.

    Actions and inputs are compared in lower case; the input example.png stands for any; an input that differs is
    right if its last path part is the same. A part that neither has is met. If both decline to use a tool, action and
    input are met.
    """
    e, m = parse_tool_call(expected), parse_tool_call(said)
    neither = lambda f: e[f].isNull() & m[f].isNull()
    no = lambda c: F.coalesce(c, F.lit(False))
    base = lambda c: F.substring_index(c, "/", -1)
    ei, mi = F.lower(e["action_input"]), F.lower(m["action_input"])
    declined = no(~e["thought_yes"] & ~m["thought_yes"])
    thought = no(e["thought_yes"] == m["thought_yes"])
    action = declined | no(F.lower(e["action"]) == F.lower(m["action"])) | neither("action")
    args = declined | no(F.when(ei == "example.png", mi != "").otherwise((ei == mi) | (base(ei) == base(mi)))) | neither("action_input")
    return F.struct(thought.alias("thought"), action.alias("action"), args.alias("args"), (thought & action & args).alias("full"))


def parse_tool_entry(instruction: Column, output: Column) -> Column:
    """(system_prompt, history_text, user_query, partial_trace, expected) of a tool-use instruction.

    The system prompt stands before "Previous conversation:", the history before "New input:", the query before the
    remark that tools are needed, and a trace after the invitation to think, if it is one. Without "New input:" what
    follows the system prompt is the query.
    """
    # fixed values: the marks of this format
    conv, new, cot, step = "Previous conversation:\n", "\nNew input: ", "\nGPT4Tools needs to use tools", "Let's think step by step.\n"

    def before(x: Column, m: str) -> Column:
        return F.when(F.instr(x, m) > 0, F.substring(x, F.lit(1), F.instr(x, m) - 1)).otherwise(x)

    def after(x: Column, m: str) -> Column:
        return F.when(F.instr(x, m) > 0, F.substring(x, F.instr(x, m) + len(m), F.length(x))).otherwise("")

    rest = after(instruction, conv)
    asked = F.instr(rest, new) > 0
    query = after(rest, new)
    trace = strip(after(after(query, cot), step))
    return F.struct(
        strip(before(instruction, conv)).alias("system_prompt"), F.when(asked, strip(before(rest, new))).otherwise("").alias("history_text"),
        strip(F.when(asked, before(query, cot)).otherwise(rest)).alias("user_query"), F.when(asked & F.startswith(trace, F.lit("Thought:")), trace).otherwise("").alias("partial_trace"),
        strip(F.coalesce(output, F.lit(""))).alias("expected"),
    )


def dialogue_turns(x: Column) -> Column:
    """ARRAY<STRUCT<role, content>> of a text in which lines beginning "Human: " and "AI: " open turns, other lines
    go on with the turn before, and lines before the first turn are dropped."""
    empty = F.array().cast("array<struct<role:string,content:string>>")

    def step(turns: Column, line: Column) -> Column:
        opened = F.startswith(line, F.lit("Human: ")) | F.startswith(line, F.lit("AI: "))
        human = F.startswith(line, F.lit("Human: "))
        new = F.struct(F.when(human, "user").otherwise("assistant").alias("role"), F.when(human, F.substring(line, 8, 1 << 30)).otherwise(F.substring(line, 5, 1 << 30)).alias("content"))
        last = F.element_at(turns, -1)
        longer = F.concat(F.slice(turns, F.lit(1), F.size(turns) - 1), F.array(F.struct(last["role"].alias("role"), F.concat(last["content"], F.lit("\n"), line).alias("content"))))
        return F.when(opened, F.concat(turns, F.array(new))).when(F.size(turns) > 0, longer).otherwise(turns)

    turns = F.aggregate(F.split(strip(x), "\n"), empty, step)
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), strip(t["content"]).alias("content")))
