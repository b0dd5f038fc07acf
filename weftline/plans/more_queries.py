"""Further queries, each with its SQL beside it: structured rule checks, source records, templates, groups and marks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, scoring, text, tokens as bpe
from ..operators import chat, corpus, curate, grouping, profile, projections
from . import oracle
from .oracle import PAIRS, last, lines, seeded, sentences, strip, tokens, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- checks of structured texts ---

SEP = "\n\n"
#: checks of the texts themselves, of entries, of logs, of JSON and of verses made of them
TEXT_CHECKS = [("words_reversed_order", {}), ("exactly_4_sentences", {}), ("paragraph_starts_spell", {"letters": "TA", "separator": SEP}), ("every_sentence_has_exactly_one_number", {}), ("alliterative_sentences", {}), ("one_caps_word_per_sentence", {}), ("consecutive_pairs_rhyme", {})]
ENTRY_CHECKS = [("body_has_4_sentences", {}), ("see_also_has_3_terms", {}), ("exactly_4_sentences", {}), ("one_caps_word_per_sentence", {}), ("every_sentence_has_exactly_one_number", {})]
VERSE_CHECKS = [("syllable_pattern_5_7_5", {}), ("consecutive_pairs_rhyme", {}), ("alliterative_sentences", {}), ("words_reversed_order", {})]
JSON_CHECKS = [("key_facts_length", {}), ("related_topics_length", {}), ("confidence_is_float_in_range", {})]


def _syllables(w: str) -> str:
    n = f"len(regexp_extract_all({w}, '[aeiouy]+'))"
    return f"greatest(1, {n} - (ends_with({w}, 'e') AND NOT ends_with({w}, 'le') AND {n} > 1)::INT)"


def _check_sql(x: str) -> dict[str, str]:
    se, li = sentences(x), lines(x)
    t = tokens("s")
    skip = checks.ALLITERATION_SKIP.split()
    first = f"list_transform(list_filter(regexp_extract_all(s, '[A-Za-z]+'), lambda w: length(w) > 1 AND NOT list_contains({skip!r}, lower(w))), lambda w: lower(w[1]))"
    mode = f"list_max(list_transform(list_distinct({first}), lambda c: len(list_filter({first}, lambda e: e = c))))"
    body = f"array_to_string(list_filter(string_split({strip(x)}, chr(10)), lambda l: NOT starts_with({strip('l')}, '=')), chr(10))"
    unmarked = f"CASE WHEN contains({x}, '>>>') AND contains({x}, '<<<') THEN array_to_string(list_filter(string_split({strip(x)}, chr(10)), lambda l: NOT regexp_matches({strip('l')}, '^(>>>|<<<)')), ' ') ELSE {x} END"
    bare = strip(f"replace(replace({x}, '{checks.OMNI_MARKERS[0]}', ''), '{checks.OMNI_MARKERS[1]}', '')")
    caps = "regexp_matches(w, '^\\pL{2,}$') AND w = upper(w) AND w != lower(w)"
    last = f"list_transform({li}, lambda l: coalesce(lower(regexp_extract_all(l, '[A-Za-z]+')[-1]), ''))"
    n = "least(3, length(e[2 * i - 1]), length(e[2 * i]))"
    a, b = "e[2 * i - 1]", "e[2 * i]"
    rhyme = f"({a} = {b} OR ({n} > 0 AND right({a}, {n}) = right({b}, {n})) OR (length({a}) >= 2 AND length({b}) >= 2 AND right({a}, 2) = right({b}, 2)))"
    pairs = f"len({li}) // 2"
    syll = f"list_transform({li}, lambda l: coalesce(list_sum(list_transform(list_transform(regexp_extract_all(l, '[A-Za-z]+'), lambda w: lower(w)), lambda w: {_syllables('w')})), 0))"
    paras = f"list_filter(list_transform(string_split({x}, chr(10) || chr(10)), lambda p: {strip('p')}), lambda p: p != '')"
    held = rf"regexp_extract({x}, '(?s)BODY:\s*(.*?)\nSEE ALSO:', 1)"
    also = rf"list_filter(list_transform(string_split(regexp_extract({x}, 'SEE ALSO:\s*(.*?)(\n|$)', 1), ','), lambda k: {strip('k')}), lambda k: k != '')"
    return {
        "words_reversed_order": f"len(list_filter({se}, lambda s: len({t}) >= 3 AND len(list_filter(({t})[-2:], lambda w: regexp_matches(w, '^\\p{{Lu}}'))) > 0)) >= len({se}) // 2",
        "exactly_4_sentences": f"len({sentences(f'({unmarked})')}) = 4",
        "paragraph_starts_spell": f"array_to_string(list_transform({paras}, lambda p: upper(p[1])), '') = 'TA'",
        "every_sentence_has_exactly_one_number": f"len(list_filter({sentences(f'({body})')}, lambda s: len(regexp_extract_all(s, '\\p{{Nd}}+')) != 1)) = 0",
        "alliterative_sentences": f"len(list_filter({se}, lambda s: len({first}) >= 3 AND {mode} * 5 >= len({first}) * 3)) * 10 >= len({se}) * 7",
        "one_caps_word_per_sentence": f"len(list_filter({sentences(f'({bare})')}, lambda s: len(list_filter({t}, lambda w: {caps})) != 1)) = 0",
        "consecutive_pairs_rhyme": f"{pairs} > 0 AND 5 * len(list_filter(list_transform([{last}], lambda e: list_filter(range(1, len(e) // 2 + 1), lambda i: {rhyme}))[1], lambda i: true)) >= 3 * ({pairs})",
        "syllable_pattern_5_7_5": f"len({li}) = 3 AND abs(({syll})[1] - 5) <= 1 AND abs(({syll})[2] - 7) <= 1 AND abs(({syll})[3] - 5) <= 1",
        "body_has_4_sentences": rf"regexp_matches({x}, '(?s)BODY:.*\nSEE ALSO:') AND len({sentences(held)}) = 4",
        "see_also_has_3_terms": f"len({also}) = 3",
    }


def _checked(id_: str, x: str, chosen: list, src: str) -> str:
    sql = _check_sql(x)
    return f"SELECT {id_}, {', '.join(f'coalesce({sql[n]}, false) AS {n}' for n, _ in chosen)} FROM {src}"


def _run(df: DataFrame, id_: str, x, chosen: list) -> DataFrame:
    return df.select(id_, *[checks.check_column(n, x, p).alias(n) for n, p in chosen])


@query(_checked("doc_id", "x", TEXT_CHECKS, "(SELECT doc_id, coalesce(text, '') AS x FROM documents)"))
def rule_checks_of_texts(s, d):
    return _run(table(s, d, "documents"), "doc_id", F.coalesce("text", F.lit("")), TEXT_CHECKS)


ENTRY_SQL = "concat(CASE WHEN example_id % 2 = 0 THEN concat('>>> ENTRY', chr(10)) ELSE '' END, '= head 1 =', chr(10), 'BODY: ', coalesce(answer, ''), chr(10), 'SEE ALSO: ', replace(left(coalesce(question, ''), 40), ' ', ','), CASE WHEN example_id % 3 = 0 THEN concat(chr(10), '<<< END') ELSE '' END)"


@query(_checked("example_id", "x", ENTRY_CHECKS, f"(SELECT example_id, {ENTRY_SQL} AS x FROM split_examples)"))
def rule_checks_of_entries(s, d):
    e = table(s, d, "split_examples")
    x = F.concat(
        F.when(F.col("example_id") % 2 == 0, ">>> ENTRY\n").otherwise(""), F.lit("= head 1 =\nBODY: "), F.coalesce("answer", F.lit("")), F.lit("\nSEE ALSO: "), F.replace(F.left(F.coalesce("question", F.lit("")), F.lit(40)), F.lit(" "), F.lit(",")),
        F.when(F.col("example_id") % 3 == 0, "\n<<< END").otherwise(""),
    )
    return _run(e, "example_id", x, ENTRY_CHECKS)


VERSE_SQL = f"concat(array_to_string(({tokens('question')})[1:3], ' '), chr(10), array_to_string(({tokens('question')})[4:7], ' '), chr(10), array_to_string(({tokens('question')})[8:10], ' '), CASE WHEN example_id % 4 = 0 THEN concat(chr(10), 'a fourth line') ELSE '' END)"


@query(_checked("example_id", "x", VERSE_CHECKS, f"(SELECT example_id, {VERSE_SQL} AS x FROM split_examples WHERE question IS NOT NULL)"))
def rule_checks_of_verses(s, d):
    e = table(s, d, "split_examples").where("question is not null")
    w = text.tokens(F.col("question"))
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    x = F.concat(part(1, 3), F.lit("\n"), part(4, 4), F.lit("\n"), part(8, 3), F.when(F.col("example_id") % 4 == 0, "\na fourth line").otherwise(""))
    return _run(e, "example_id", x, VERSE_CHECKS)


_FACTS = ["[1, 2, 3]", "[1]", "\"abc\"", "{\"a\": 1, \"b\": 2, \"c\": 3}", "null", "7"]
_TOPICS = ["[\"x\", \"y\"]", "\"xy\"", "[]"]
_SURE = ["0.5", "1", "1.5", "true", "\"0.5\"", "-0.1", "null"]


@query("""WITH j AS (SELECT event_id, [3, 1, 3, 3, 0, 0][event_id % 6 + 1] AS facts, [2, 2, 0][event_id % 3 + 1] AS topics, event_id % 7 IN (0, 1, 3) AS sure, event_id % 11 = 0 AS broken FROM events)
    SELECT event_id, NOT broken AND facts = 3 AS key_facts_length, NOT broken AND topics = 2 AS related_topics_length, NOT broken AND sure AS confidence_is_float_in_range FROM j""")
def rule_checks_of_json(s, d):
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), F.pmod("event_id", F.lit(len(xs))).cast("int"))
    x = F.concat(F.lit('{"key_facts": '), pick(_FACTS), F.lit(', "related_topics": '), pick(_TOPICS), F.lit(', "confidence": '), pick(_SURE), F.when(F.col("event_id") % 11 == 0, "").otherwise("}"))
    return _run(table(s, d, "events"), "event_id", x, JSON_CHECKS)


@query("""WITH g AS (SELECT event_type, list((date_part('hour', ts) * 3600 + date_part('minute', ts) * 60) * 1000 + event_id % 1000 ORDER BY event_id) AS t FROM events GROUP BY event_type, event_id // 3)
    SELECT event_type, count(*) AS n, count_if(len(t) >= 2 AND len(list_filter(range(1, len(t)), lambda i: t[i] >= t[i + 1])) = 0) AS rising FROM g GROUP BY 1""")
def timestamp_checks(s, d):
    stamp = F.concat(F.lit("["), F.date_format("ts", "HH:mm"), F.lit(":00."), F.lpad(F.pmod("event_id", F.lit(1000)).cast("string"), 3, "0"), F.lit("] {INFO} done"))
    logs = table(s, d, "events").select("event_type", F.floor(F.col("event_id") / 3).alias("g"), "event_id", stamp.alias("line")).groupBy("event_type", "g").agg(F.array_sort(F.collect_list(F.struct("event_id", "line"))).alias("l"))
    x = F.array_join(F.transform("l", lambda v: v["line"]), "\n")
    return logs.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(checks.check_column("timestamps_sequential", x)).alias("rising"))


@query(f"""WITH w AS (SELECT example_id, lower(regexp_extract_all(question, '[A-Za-z]+')[-1]) AS a, lower(coalesce(regexp_extract_all(answer, '[A-Za-z]+')[-1], '')) AS b FROM split_examples WHERE question IS NOT NULL AND regexp_matches(question, '[A-Za-z]')),
    m AS (SELECT *, least(3, length(a), length(b)) AS n FROM w)
    SELECT example_id, a = b OR (n > 0 AND right(a, n) = right(b, n)) OR (length(a) >= 2 AND length(b) >= 2 AND right(a, 2) = right(b, 2)) AS rhymes FROM m""")
def rhyming_ends(s, d):
    last_word = lambda c: F.coalesce(F.lower(F.try_element_at(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)), F.lit(-1))), F.lit(""))
    e = table(s, d, "split_examples").where(F.col("question").isNotNull() & F.rlike("question", F.lit("[A-Za-z]")))
    return e.select("example_id", text.rhymes(last_word(F.col("question")), last_word(F.col("answer"))).alias("rhymes"))


def _default_checks() -> dict[str, str]:
    """All checks with their default parameters, over texts that are no JSON and have no time stamps."""
    li, paras = lines("a"), f"list_filter(list_transform(string_split(a, '{checks.SEPARATOR}'), lambda p: {strip('p')}), lambda p: p != '')"
    sql = {**oracle._more_checks(), **oracle._checks(), **_check_sql("a")}
    sql |= {c: "true" for c in ("contains_string", "not_contains_string", "starts_with", "ends_with")}
    sql |= {c: "false" for c in ("simple_vocabulary", "has_exact_keys", "key_facts_length", "related_topics_length", "confidence_is_float_in_range", "timestamps_sequential")}
    sql |= {
        "min_pirate_terms": sql["min_pirate_terms"].replace(">= 1", ">= 5"), "exactly_n_lines": f"len({li}) = 9", "acrostic_spells": f"len({li}) = 0", "exactly_n_paragraphs_with_separator": f"len({paras}) = 5",
        "each_paragraph_n_sentences": f"len(list_filter({paras}, lambda p: len({sentences('p')}) != 3)) = 0", "paragraph_starts_spell": f"array_to_string(list_transform({paras}, lambda p: upper(p[1])), '') = 'FSTFF'",
    }
    return {c: sql[c] for c in checks.CHECKS}


_ALL = _default_checks()


@query(f"""WITH c AS (SELECT {', '.join(f'coalesce({v}, false) AS {k}' for k, v in _ALL.items())} FROM (SELECT coalesce(answer, '') AS a FROM split_examples)),
    u AS (UNPIVOT c ON {', '.join(_ALL)} INTO NAME name VALUE passed) SELECT name, count(*) AS n, count_if(passed) AS passed FROM u GROUP BY 1""")
def rule_checks_all(s, d):
    e = table(s, d, "split_examples").select(F.coalesce("answer", F.lit("")).alias("a"))
    per = e.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), checks.check_column(n, F.col("a")).alias("passed")) for n in checks.CHECKS])).alias("c"))
    return per.groupBy("c.name").agg(F.count("*").alias("n"), F.count_if("c.passed").alias("passed"))


# --- answers and prompts ---


@query("""WITH j AS (SELECT example_id, coalesce(answer, '') AS a, coalesce(answer_8b, '') AS b FROM split_examples)
    SELECT example_id, md5(array_to_string(CASE example_id % 6 WHEN 0 THEN [a] WHEN 1 THEN [a, b] WHEN 2 THEN [a, b] WHEN 3 THEN [a, b] WHEN 4 THEN [a] ELSE [''] END, '|')) AS golds FROM j""")
def answer_lists(s, d):
    a, b = F.coalesce("answer", F.lit("")), F.coalesce("answer_8b", F.lit(""))
    js = lambda x: F.to_json(x)
    k = F.pmod("example_id", F.lit(6))
    # a text, an array of texts, an array of objects with text or answer, an object with answers.text, with text, null
    raw = F.when(k == 0, F.regexp_extract(js(F.struct(a.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)).when(k == 1, js(F.array(a, b))).when(k == 2, F.concat(F.lit("["), js(F.struct(a.alias("text"))), F.lit(","), js(F.struct(b.alias("answer"))), F.lit("]")))
    raw = raw.when(k == 3, js(F.struct(F.struct(F.array(a, b).alias("text")).alias("answers")))).when(k == 4, js(F.struct(a.alias("text")))).otherwise("null")
    return table(s, d, "split_examples").select("example_id", F.md5(F.array_join(scoring.answer_list(F.parse_json(raw)), "|")).alias("golds"))


@query("SELECT example_id, CASE WHEN example_id % 2 = 0 THEN coalesce(answer, '') ELSE concat('x', question, coalesce(answer, '')) END AS answer FROM split_examples WHERE question IS NOT NULL")
def echoed_prompts(s, d):
    full = F.concat(F.when(F.col("example_id") % 2 == 0, "").otherwise("x"), F.col("question"), F.coalesce("answer", F.lit("")))
    return table(s, d, "split_examples").where("question is not null").select("example_id", text.without_echo(full, F.col("question")).alias("answer"))


_M = "concat('<|im_start|>', {0}, chr(10), {1}, '<|im_end|>', chr(10))"


@query(f"""SELECT i.item_id, md5(concat({_M.format("'system'", "i.dataset")}, coalesce(string_agg(concat({_M.format("'user'", "coalesce(p.question, '')")}, {_M.format("'assistant'", "coalesce(p.answer, '')")}), '' ORDER BY p.pos) FILTER (p.pos IS NOT NULL), ''),
    {_M.format("'user'", "CASE WHEN i.item_id % 2 = 0 THEN 'go on' ELSE concat('go on', chr(10), 'Thought: so far') END")}, '<|im_start|>assistant' || chr(10))) AS digest
    FROM ift_data_pwc i LEFT JOIN {PAIRS} p USING (item_id) GROUP BY i.item_id, i.dataset""")
def evaluation_prompts(s, d):
    i = table(s, d, "ift_data_pwc").withColumn("h", chat.conversation(F.coalesce(chat.pairs_of(F.col("conversations")), F.array().cast("array<struct<question:string,answer:string>>"))))
    m = chat.evaluation_messages(F.col("dataset"), F.col("h"), F.lit("go on"), F.when(F.col("item_id") % 2 == 1, "Thought: so far"))
    return i.select("item_id", F.md5(chat.render(m, True)).alias("digest"))


@query("""SELECT example_id, md5(concat('<|im_start|>system', chr(10), coalesce(context, ''), chr(10), chr(10), '# Tools', chr(10), chr(10), 'You may call one or more functions to assist with the user query.', chr(10), chr(10), 'You are provided with function signatures within <tools></tools> XML tags:', chr(10), '<tools>', chr(10), '{"name": "look"}', chr(10), '</tools>', chr(10), chr(10),
    'For each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:', chr(10), '<tool_call>', chr(10), '{"name": <function-name>, "arguments": <args-json-object>}', chr(10), '</tool_call><|im_end|>', chr(10),
    '<|im_start|>user', chr(10), coalesce(question, ''), '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10), '<think>', chr(10), chr(10), '</think>', chr(10), chr(10))) AS digest FROM split_examples""")
def tool_prompts(s, d):
    m = F.array(chat.message("system", F.col("context")), chat.message("user", F.col("question")))
    return table(s, d, "split_examples").select("example_id", F.md5(chat.render(m, True, tools=['{"name": "look"}'], thinking=False)).alias("digest"))


@query("SELECT item_id, len(conversations) AS messages, len(list_filter(conversations, lambda m: m.role = 'assistant')) AS answers, coalesce(list_sum(list_transform(conversations, lambda m: length(coalesce(m.content, '')))), 0)::INT AS chars FROM ift_data_pwc WHERE conversations IS NOT NULL")
def questions_and_answers(s, d):
    i = table(s, d, "ift_data_pwc").where("conversations is not null")
    both = F.concat(chat.questions_of(F.col("conversations")), chat.answers_of(F.col("conversations")))
    return i.select("item_id", F.size("conversations").alias("messages"), F.size(chat.answers_of(F.col("conversations"))).alias("answers"), F.aggregate(both, F.lit(0), lambda n, c: n + F.length(F.coalesce(c, F.lit("")))).alias("chars"))


# --- projections of source records ---


@query("""SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10) || chr(10)), lambda p: array_to_string(string_split(p, chr(10)), '')), chr(10) || chr(10))) AS context, source AS question, lang AS answer FROM documents WHERE text IS NOT NULL""")
def nested_projection(s, d):
    t = table(s, d, "documents").where("text is not null").withColumn("p", F.transform(F.split("text", "\n\n"), lambda p: F.split(p, "\n")))
    return corpus.nested_sentences(t, "p", "source", "lang", keep=["doc_id"]).withColumn("context", F.md5("context"))


@query(f"""SELECT item_id, md5(array_to_string(list_filter(list_transform(conversations, lambda m: m.content), lambda c: c IS NOT NULL), chr(10) || chr(10))) AS context, dataset AS question, concat_ws('|', {strip('concat(chr(32), dataset, chr(9))')}, CASE WHEN item_id % 2 = 0 THEN 'b' END) AS answers FROM ift_data_pwc WHERE conversations IS NOT NULL""")
def alias_projection(s, d):
    t = table(s, d, "ift_data_pwc").where("conversations is not null").withColumn("p", F.transform("conversations", lambda m: F.struct(m["content"].alias("paragraph_text")))).withColumn("a", F.concat(F.lit(" "), "dataset", F.lit("\t")))
    t = t.withColumn("more", F.when(F.col("item_id") % 2 == 0, F.array(F.lit(" b "))))
    return corpus.joined_paragraphs(t, "p", "dataset", "a", "more", keep=["item_id"]).select("item_id", F.md5("context").alias("context"), "question", F.array_join("answers", "|").alias("answers"))


@query("SELECT system_prompt_id, question_id, concat('system:', c, '|user:', q) AS messages FROM (SELECT DISTINCT system_prompt_id, question_id, md5(coalesce(context, '')) AS c, md5(coalesce(question, '')) AS q FROM split_examples)")
def context_messages(s, d):
    m = projections.messages_with_context(F.md5(F.coalesce("context", F.lit(""))), F.md5(F.coalesce("question", F.lit(""))))
    return table(s, d, "split_examples").select("system_prompt_id", "question_id", F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|").alias("messages")).distinct()


@query("SELECT system_prompt_id, evidence, len(questions) AS questions FROM (SELECT system_prompt_id, md5(any_value(context)) AS evidence, list(question) AS questions FROM split_examples WHERE context IS NOT NULL GROUP BY system_prompt_id, context)")
def human_projection(s, d):
    g = table(s, d, "split_examples").where("context is not null").groupBy("system_prompt_id", "context").agg(F.collect_list("question").alias("questions"))
    p = projections.human_projection(g, "context", "questions", keep=["system_prompt_id"])
    return p.select("system_prompt_id", F.md5("evidence").alias("evidence"), F.size("questions").alias("questions"))


_INSTRUCTION = "concat('You are tool ', dataset, '.', chr(10), CASE WHEN item_id % 3 > 0 THEN concat('Previous conversation:', chr(10), 'Human: ', item_id, CASE WHEN item_id % 3 = 1 THEN concat(chr(10), 'New input: look at ', contextlen, chr(10), 'GPT4Tools needs to use tools to help. Let''s think step by step.', chr(10), CASE WHEN item_id % 2 = 0 THEN ' Thought: yes ' ELSE 'no trace' END) ELSE '' END) ELSE '' END)"


@query(f"""SELECT item_id, concat('You are tool ', dataset, '.') AS system_prompt, CASE WHEN item_id % 3 = 1 THEN concat('Human: ', item_id) ELSE '' END AS history_text,
    CASE item_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat('look at ', contextlen) ELSE concat('Human: ', item_id) END AS user_query, CASE WHEN item_id % 3 = 1 AND item_id % 2 = 0 THEN 'Thought: yes' ELSE '' END AS partial_trace, dataset AS expected FROM ift_data_pwc WHERE contextlen IS NOT NULL""")
def tool_entries(s, d):
    new = F.concat(F.lit("\nNew input: look at "), F.col("contextlen").cast("string"), F.lit("\nGPT4Tools needs to use tools to help. Let's think step by step.\n"), F.when(F.col("item_id") % 2 == 0, " Thought: yes ").otherwise("no trace"))
    rest = F.concat(F.lit("Previous conversation:\nHuman: "), F.col("item_id").cast("string"), F.when(F.col("item_id") % 3 == 1, new).otherwise(""))
    t = F.concat(F.lit("You are tool "), "dataset", F.lit(".\n"), F.when(F.col("item_id") % 3 > 0, rest).otherwise(""))
    e = table(s, d, "ift_data_pwc").where("contextlen is not null").select("item_id", scoring.parse_tool_entry(t, F.concat(F.lit(" "), "dataset")).alias("e"))
    return e.select("item_id", "e.*")


_GOOD_Q = f"q.on_topic IS NOT NULL AND q.difficulty IS NOT NULL AND q.intent IS NOT NULL AND length({strip('q.question')}) >= 5"


@query(f"SELECT coalesce(len(list_filter(questions, lambda q: q.on_topic)) = 10 AND len(list_filter(questions, lambda q: NOT q.on_topic)) = 2 AND len(questions) = 12 AND len(list_filter(questions, lambda q: {_GOOD_Q})) = 12, false) AS ok, count(*) AS n FROM questions GROUP BY 1")
def valid_question_texts(s, d):
    """The same on JSON as a model writes it, in which a field without a value is missing."""
    return table(s, d, "questions").groupBy(curate.valid_question_json(F.to_json("questions"), 10, 2).alias("ok")).agg(F.count("*").alias("n"))


# --- groups of contexts ---


def _random(length: int, seed: int) -> str:
    return f"""(WITH t AS (SELECT count(*) AS c, greatest(1, ceil(sum({words('text')}) / {length}.0))::BIGINT AS g FROM documents), r AS (SELECT doc_id, text, row_number() OVER (ORDER BY {seeded('doc_id', seed)}, doc_id) - 1 AS place FROM documents),
        s AS (SELECT c // g AS small, c % g AS more FROM t)
        SELECT doc_id, text, CASE WHEN small > 0 AND place >= more * (small + 1) THEN more + (place - more * (small + 1)) // greatest(small, 1) ELSE place // (small + 1) END AS group_id FROM r, s)"""


@query(f"SELECT group_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY {seeded('doc_id', 2)})) AS context FROM {_random(1500, 5)} WHERE text IS NOT NULL GROUP BY 1")
def grouped_contexts(s, d):
    t = table(s, d, "documents")
    g = grouping.random_groups(t, "doc_id", text.word_count(F.col("text")), 1500, 5)
    return grouping.group_contexts(g, t.where("text is not null"), "doc_id", "text", seed=2).select("group_id", F.md5("context").alias("context"))


_EXTERNAL = f"(SELECT item_id // 7 AS group_id, item_id, {words('context')} AS n, {strip('context')} AS t FROM ift_data_pwc WHERE context IS NOT NULL)"


@query(f"SELECT group_id, count(*) AS items, sum(n)::BIGINT AS length FROM {_EXTERNAL} GROUP BY 1 ORDER BY length DESC, group_id LIMIT 20")
def longest_groups(s, d):
    """The 20 longest groups of an index made elsewhere: a top-k report."""
    t = table(s, d, "ift_data_pwc").where("context is not null")
    index = t.select(F.floor(F.col("item_id") / 7).cast("long").alias("group_id"), "item_id")
    return grouping.longest(grouping.group_lengths(index, t, "item_id", text.word_count(F.col("context"))), 20)


@query(f"""WITH g AS (SELECT group_id, count(*) AS items, sum(n)::BIGINT AS length FROM {_EXTERNAL} GROUP BY 1)
    SELECT count(*) AS n, round(avg(length), 6) AS mean, round(stddev_pop(length), 6) AS std, round(quantile_cont(length, 0.5), 6) AS median, round(quantile_cont(length, 0.1), 6) AS p10, round(quantile_cont(length, 0.9), 6) AS p90, min(length) AS min, max(length) AS max, sum(items)::BIGINT AS items FROM g""")
def group_statistics(s, d):
    t = table(s, d, "ift_data_pwc").where("context is not null")
    index = t.select(F.floor(F.col("item_id") / 7).cast("long").alias("group_id"), "item_id")
    g = grouping.group_lengths(index, t, "item_id", text.word_count(F.col("context")))
    return g.agg(*profile.stat_pack(F.col("length"), 6), F.min("length").alias("min"), F.max("length").alias("max"), F.sum("items").alias("items"))


@query(f"SELECT group_id, count(*) AS items, sum(n)::BIGINT AS length FROM {_EXTERNAL} WHERE n <= 400 GROUP BY 1")
def groups_without_exceeding(s, d):
    """Members longer than a limit leave their groups; groups that lose all are gone."""
    t = table(s, d, "ift_data_pwc").where("context is not null")
    index = t.select(F.floor(F.col("item_id") / 7).cast("long").alias("group_id"), "item_id")
    n = text.word_count(F.col("context"))
    return grouping.group_lengths(grouping.without_members(index, t.where(n > 400), "item_id"), t, "item_id", n)


@query("SELECT group_id, md5(string_agg(t, '<|endoftext|>' ORDER BY " + seeded("item_id", 4) + f")) AS context FROM {_EXTERNAL} GROUP BY 1")
def external_group_contexts(s, d):
    t = table(s, d, "ift_data_pwc").where("context is not null")
    index = t.select(F.floor(F.col("item_id") / 7).cast("long").alias("group_id"), "item_id")
    return grouping.group_contexts(index, t.withColumn("context", text.strip(F.col("context"))), "item_id", "context", "<|endoftext|>", 4).select("group_id", F.md5("context").alias("context"))


@query("SELECT b // 5 AS bin, md5(string_agg(t, '|' ORDER BY slot)) AS texts FROM (SELECT item_id AS b, item_id % 5 AS slot, coalesce(context, '') AS t FROM ift_data_pwc) GROUP BY 1")
def packed_texts(s, d):
    t = table(s, d, "ift_data_pwc").withColumn("context", F.coalesce("context", F.lit("")))
    bins = t.select(F.lit(0).alias("shard"), F.floor(F.col("item_id") / 5).cast("long").alias("bin"), F.pmod("item_id", F.lit(5)).cast("int").alias("slot"), F.col("item_id").alias("pos"))
    return grouping.bin_texts(bins, t, "item_id", "context").select("bin", F.md5(F.array_join("texts", "|")).alias("texts"))


@query("""WITH n AS (SELECT example_id, least(len(a), 40) AS n, least(len(a) // 3, least(len(a), 40)) AS l FROM (SELECT example_id, string_split(answer, '') AS a FROM split_examples WHERE length(answer) > 0))
    SELECT example_id, n::INT AS n, (n - l)::INT AS ignored FROM n""")
def suffix_label_arrays(s, d):
    # code points stand for tokens
    e = table(s, d, "split_examples").where("length(answer) > 0").withColumn("ids", F.transform(F.filter(F.split("answer", ""), lambda c: c != ""), lambda c: F.ascii(c)))
    labels = chat.suffix_labels(F.slice("ids", 1, 40), F.floor(F.size("ids") / 3).cast("int"))
    return e.select("example_id", F.size(labels).alias("n"), F.size(F.filter(labels, lambda x: x == chat.IGNORE)).alias("ignored"))


@query("""WITH a AS (SELECT example_id // 8 AS batch, least(length(answer), 200) AS n FROM split_examples WHERE length(answer) > 0), b AS (SELECT batch, count(*) AS items, max(n) AS width, sum(n) AS used FROM a GROUP BY 1)
    SELECT batch, items, width::INT AS width, used::BIGINT AS used, (items * width - used)::BIGINT AS padding FROM b""")
def collated_batches(s, d):
    """Batches of eight examples padded to their longest member."""
    e = table(s, d, "split_examples").where("length(answer) > 0").select(F.floor(F.col("example_id") / 8).cast("long").alias("batch"), "example_id", F.slice(F.transform(F.filter(F.split("answer", ""), lambda c: c != ""), lambda c: F.ascii(c)), 1, 200).alias("ids"))
    c = chat.collate(e, "batch", "example_id", "ids", F.col("ids"), pad=0)
    used = F.aggregate(F.flatten("mask"), F.lit(0).cast("long"), lambda n, x: n + x)
    return c.select("batch", F.size("ids").cast("long").alias("items"), F.size(F.get("ids", 0)).alias("width"), used.alias("used"), (F.size("ids") * F.size(F.get("ids", 0)) - used).alias("padding"))


# --- lengths in tokens, and what depends on the whole order ---


@query()
def token_lengths(s, d):
    """Tokens of contexts and of templated conversations by a public tokenizer, as packing and gates count them."""
    i = table(s, d, "ift_data_pwc")
    both = F.array(F.col("context"), chat.render(F.coalesce("conversations", F.array().cast("array<struct<role:string,content:string>>"))))
    return bpe.count_tokens(i, ["item_id"], both)


@query()
def token_label_arrays(s, d):
    """Ids and labels of question and answer in the tokens of a public tokenizer, cut to 128."""
    e = table(s, d, "split_examples").where("question is not null and answer is not null")
    q = bpe.token_ids(e, ["example_id"], F.col("question")).withColumnRenamed("ids", "q")
    a = bpe.token_ids(e, ["example_id"], F.col("answer")).withColumnRenamed("ids", "a")
    m = q.join(a, "example_id").select("example_id", chat.prefix_labels(F.col("q"), F.col("a"), 128).alias("l"))
    return m.select("example_id", F.size(F.filter("l.labels", lambda x: x != chat.IGNORE)).alias("learnt"), F.aggregate("l.mask", F.lit(0), lambda n, x: n + x).alias("used"))


def _off_topic(x: str) -> str:
    return f"(coalesce(k.kind = 'off_topic', false) OR coalesce(TRY_CAST(list_last(string_split({x}, '_q')) AS INT) >= 11, false))"


_TRI = lambda x: f"CASE WHEN length({x}) = 0 THEN [] WHEN length({x}) < 3 THEN [{x}] ELSE list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3))) END"


@query(f"""WITH k AS (SELECT q.id AS question_id, max(coalesce(q.type, 'on_topic')) AS kind FROM (SELECT unnest(questions) AS q FROM questions) GROUP BY 1),
    p AS (SELECT a.question_id, coalesce(a.answer, '') AS x, coalesce(b.answer, '') AS y, {_off_topic('a.question_id')} AS off_topic
        FROM {last('responses_32b', 'question_id', 'loaded_at')} a JOIN {last('responses_8b', 'question_id', 'loaded_at')} b ON a.question_id = b.question_id LEFT JOIN k ON k.question_id = a.question_id),
    t AS (SELECT *, {strip('x')} = '' OR {strip('y')} = '' AS empty, {_TRI('x')} AS tx, {_TRI('y')} AS ty FROM p), j AS (SELECT *, len(list_intersect(tx, ty)) AS b FROM t)
    SELECT question_id, off_topic, empty, CASE WHEN NOT empty THEN round(b::DOUBLE / (len(tx) + len(ty) - b), 4) END AS trigram_jaccard,
        CASE WHEN empty THEN false WHEN off_topic OR b::DOUBLE / (len(tx) + len(ty) - b) <= 0.85 THEN true END AS kept FROM j""")
def similarity_filter_decided(s, d):
    """What the filter decides without the edit distance; kept is null where that one decides."""
    p = curate.response_pairs(table(s, d, "responses_32b"), table(s, d, "responses_8b"))
    f = curate.similarity_filter(p, curate.exploded_questions(table(s, d, "questions")).select("question_id", "question_type"))
    empty = F.col("reason") == "empty_response"
    sure = F.when(empty | F.col("off_topic") | (F.col("trigram_jaccard") <= 0.85), F.col("kept"))
    return f.select("question_id", "off_topic", empty.alias("empty"), "trigram_jaccard", sure.alias("kept"))


@query("""WITH RECURSIVE items AS (SELECT row_number() OVER (ORDER BY item_id) AS i, item_id AS pos, (coalesce(contextlen, 0) + 11)::INT AS cost FROM ift_data_pwc),
    st AS (SELECT 0::BIGINT AS i, list_transform(range(100), lambda k: 1150) AS room, list_transform(range(100), lambda k: -1::BIGINT) AS grp, -1::BIGINT AS g, -1::BIGINT AS closed
        UNION ALL
        SELECT i, CASE WHEN cost > 1150 THEN room ELSE list_transform(range(1, 101), lambda k: CASE WHEN k != pick THEN room[k] WHEN fits THEN room[k] - cost ELSE 1150 - cost END) END,
            CASE WHEN cost > 1150 THEN grp ELSE list_transform(range(1, 101), lambda k: CASE WHEN k = pick AND (NOT fits OR grp[k] < 0) THEN i ELSE grp[k] END) END,
            CASE WHEN cost > 1150 OR NOT fits OR grp[pick] < 0 THEN i ELSE grp[pick] END, CASE WHEN cost > 1150 THEN i WHEN NOT fits THEN grp[pick] ELSE -1 END
        FROM (SELECT t.i, room, grp, cost, list_max(room) >= cost AS fits, CASE WHEN list_max(room) >= cost THEN list_position(list_transform(room, lambda r: r >= cost), true) ELSE list_position(room, list_min(room)) END AS pick
            FROM st JOIN items t ON t.i = st.i + 1)),
    ends AS (SELECT i, grp FROM st ORDER BY i DESC LIMIT 1),
    closes AS (SELECT closed AS g, i AS pick FROM st WHERE closed > 0 UNION ALL SELECT grp[k], i + k FROM (SELECT i, grp, unnest(range(1, 101)) AS k FROM ends) WHERE grp[k] > 0),
    bins AS (SELECT g, row_number() OVER (ORDER BY pick) - 1 AS bin FROM closes)
    SELECT 0 AS shard, bin::INT AS bin, (row_number() OVER (PARTITION BY bins.g ORDER BY t.pos) - 1)::INT AS slot, t.pos, t.cost FROM items t JOIN st ON st.i = t.i JOIN bins ON bins.g = st.g""")
def greedy_packing(s, d):
    return grouping.greedy_pack(table(s, d, "ift_data_pwc"), "item_id", F.col("contextlen"), 1150, shards=1)


@query(f"""SELECT sha256({strip('context')}) AS context, count(*) AS turns, md5(string_agg(md5(coalesce(question, '')), '' ORDER BY example_id)) AS digest FROM split_examples WHERE context IS NOT NULL GROUP BY {strip('context')}""")
def grouped_question_parts(s, d):
    """Turns of a context in bounded parts; put together here only to compare them, by a digest for each turn."""
    p = corpus.grouped_parts(table(s, d, "split_examples"), "context", "question", "answer", "example_id", 50)
    each = p.select("h", "part", F.size("pairs").alias("n"), F.array_join(F.transform("pairs", lambda x: F.md5(F.coalesce(x["question"], F.lit("")))), "").alias("t"))
    g = each.groupBy("h").agg(F.sum("n").alias("turns"), F.array_sort(F.collect_list(F.struct("part", "t"))).alias("x"))
    return g.select(F.col("h").alias("context"), "turns", F.md5(F.array_join(F.transform("x", lambda x: x["t"]), "")).alias("digest"))
