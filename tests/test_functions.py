import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import scoring, text
from weftline.functions.checks import CHECKS, check_column, run_checks, tally

X, Y = F.col("x"), F.col("y")
TEXTS = st.text(alphabet="ab theAn.!? \n\t ,'eéß😀1", max_size=24)
ONE_JVM = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def python_normalize(s):
    s = "".join(c for c in s.lower() if c not in text.PUNCTUATION)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())


def python_f1(g, p):
    a, b = python_normalize(g).split(), python_normalize(p).split()
    if not a or not b:
        return float(a == b)
    n = sum((Counter(a) & Counter(b)).values())
    return 2 * n / (len(a) + len(b)) if n else 0.0


@ONE_JVM
@given(st.lists(st.tuples(TEXTS, TEXTS), min_size=30, max_size=40))
def test_text_functions_agree_with_python(spark, pairs):
    rows = spark.createDataFrame(pairs, "x string, y string").select(
        "x", "y", text.normalize_answer(X).alias("n"), text.tokens(X).alias("t"), text.strip(X).alias("s"), text.sentences(X).alias("se"), scoring.token_f1(X, Y).alias("f1"),
        scoring.trigram_jaccard(X, Y).alias("j"), text.prefix_match(text.tokens(X), text.tokens(Y)).alias("pm"), scoring.edit_distance(X, Y).alias("e"),
    ).collect()
    from difflib import SequenceMatcher

    for r in rows:
        assert r.n == python_normalize(r.x)
        assert r.t == r.x.split()
        assert r.s == r.x.strip()
        assert r.se == [s.strip() for s in re.split(r"(?<=[.!?])\s+", r.x.strip()) if s.strip()]
        assert r.f1 == pytest.approx(python_f1(r.x, r.y))
        tri = lambda s: {s[i : i + 3] for i in range(len(s) - 2)} if len(s) >= 3 else ({s} if s else set())
        a, b = tri(r.x), tri(r.y)
        assert r.j == pytest.approx(1.0 if not a and not b else len(a & b) / len(a | b))
        t, u = r.x.split(), r.y.split()
        first = next((i for i, w in enumerate(t) if i >= len(u) or u[i] != w), len(t))
        assert r.pm == pytest.approx(first / len(t) if t else 1.0)
        assert r.e == pytest.approx(0.0 if not r.x and not r.y else 1 - SequenceMatcher(None, r.x, r.y).ratio())


@pytest.mark.parametrize("gold, said, f1, strict", [("", "", 1, 0), ("the", "a", 1, 0), ("x", "", 0, 0), ("yes", "no", 0, 0), ("Yes.", "yes", 1, 1), ("it's", "its", 1, 1), ("a a b", "a a a c", 0, 0), ("x x y", "x x x z", 4 / 7, 4 / 7), ("yes sir", "yes", 2 / 3, 0), (None, "", 1, 0)])
def test_f1_edges(value, gold, said, f1, strict):
    assert value(scoring.token_f1(X, Y), x=gold, y=said) == pytest.approx(f1)
    assert value(scoring.strict_f1(X, Y), x=gold, y=said) == pytest.approx(strict)


def test_long_form_f1_is_the_same(spark):
    df = spark.createDataFrame([(1, "x x y", "x x x z"), (2, "", ""), (3, "a", "b"), (4, None, "w"), (5, "m n", "n m")], "k int, x string, y string")
    short = {r.k: r.f for r in df.select("k", scoring.token_f1(X, Y).alias("f")).collect()}
    assert {r.k: r.f1 for r in scoring.token_f1_rows(df, "k", "x", "y").collect()} == pytest.approx(short)


TAGGED = {"none": " Answer: hi\nthere ", "both": "<think>a</think>b\nc", "open": "<think>\nrest of it", "close": "x</think>y", "reversed": "</think>a<think>b", "upper": "<THINK>a</THINK>b"}


@pytest.mark.parametrize("variant, expected", [
    ("responses", [("", "Answer: hi\nthere"), ("a", "b\nc"), ("", "rest of it"), ("[error]", "x</think>y"), ("[error]", "</think>a<think>b"), ("a", "b")]),
    ("qa", [("", "hi"), ("a", "b"), ("", "<think>"), ("", "x</think>y"), ("", "</think>a<think>b"), ("a", "b")]),
    ("turns", [("", "hi"), ("a", "b"), ("", "rest of it"), ("[error]", "x</think>y"), ("[error]", "</think>a<think>b"), ("a", "b")]),
    ("plain", [("", "hi\nthere"), ("a", "b\nc"), ("rest of it", ""), ("", "x</think>y"), ("b", ""), ("", "<THINK>a</THINK>b")]),
    ("tools", [("", "Answer: hi\nthere"), ("a", "b\nc"), ("rest of it", ""), ("", "x</think>y"), ("b", ""), ("", "<THINK>a</THINK>b")]),
])
def test_think_variants(spark, variant, expected):
    df = spark.createDataFrame([(t,) for t in TAGGED.values()], "x string").coalesce(1)
    assert [tuple(r.t) for r in df.select(scoring.split_think(X, variant).alias("t")).collect()] == expected


def test_scalars(value):
    assert value(text.capitalize_first(X), x="ßa") == "SSa"
    assert value(text.capitalize_first(X, only_lower=True), x="Ab") == "Ab"
    assert value(text.approx_tokens(X), x="a b c") == 4
    assert value(text.approx_tokens(X), x=None) == 0
    assert value(text.rot13(X), x="Uryyb, jbeyq") == "Hello, world"
    assert [value(text.syllables(X), x=w) for w in ("", "made", "little", "the", "queue")] == [0, 1, 2, 1, 1]
    assert value(text.rhymes(X, Y), x="bright", y="night") and not value(text.rhymes(X, Y), x="ab", y="ac")
    assert value(text.stamp_millis(X), x="[01:02:03.004] x") == 3_723_004
    assert value(text.stamp_millis(X), x="01:02") is None
    assert value(text.wiki_title(X), x=" == A b == ") == "A b" and value(text.wiki_title(X), x="A = b") is None
    assert value(text.without_echo(X, Y), x="ask: yes", y="ask:") == " yes" and value(text.without_echo(X, Y), x="no", y="ask") == "no"
    assert value(text.preview(X, 3), x="abcd") == "abc..." and value(text.preview(X, 3), x="abc") == "abc"
    assert value(text.length_ratio(X, Y), x="abc", y="") == 3.0
    assert value(text.valid_article(X), x="one two three four five") and not value(text.valid_article(X), x=None)
    assert tuple(value(text.completion(X, F.lit(0.01)), x="a b c")) == ("a", "b c")
    assert tuple(value(text.completion(X, F.lit(0.5)), x="")) == ("text", "Nothing to complete.")
    assert value(text.file_name(X), x="a b/c") == "a_b_c"


@pytest.mark.parametrize("raw, path, got", [('{"a": 1}', "$.a", 1), ('x ```json\n{"a": 2}\n``` y', "$.a", 2), ('so [{"a": 3}] there', "$[0].a", 3), ('so {"a": 4} there', "$.a", 4), ("5 [none", "$", None), ("none", "$.a", None)])
def test_json_response(value, raw, path, got):
    assert value(F.try_variant_get(text.json_response(X), path, "int"), x=raw) == got


@pytest.mark.parametrize("truth, golds", [("null", [""]), ('"a"', ["a"]), ('["a", "b"]', ["a", "b"]), ('[{"text": "a"}, {"answer": "b"}]', ["a", "b"]), ('{"text": ["a"]}', ["a"]), ('{"answers": {"text": ["a", "b"]}}', ["a", "b"]), ("7", ["7"])])
def test_answer_list(value, truth, golds):
    assert value(scoring.answer_list(F.parse_json(X)), x=truth) == golds


def test_best_over_and_facts(spark):
    df = spark.createDataFrame([(["a b", "c"], "c"), ([], "c")], "g array<string>, s string").coalesce(1)
    assert [r.v for r in df.select(scoring.best_over(F.col("g"), F.col("s"), scoring.token_f1).alias("v")).collect()] == [1.0, 0.0]
    facts = spark.createDataFrame([(["a", "a", "b"], ["b", "c"]), ([], [])], "p array<string>, g array<string>").coalesce(1)
    assert [tuple(r.v) for r in facts.select(scoring.fact_scores(F.col("p"), F.col("g")).alias("v")).collect()] == [(0.5, 0.5, 0.5, 0.0), (0.0, 0.0, 0.0, 1.0)]


YES = "Thought: Do I need to use a tool? Yes\nAction: Edge\nAction Input: image/a.png"


@pytest.mark.parametrize("expected, said, flags", [
    (YES, YES.replace("Edge", "edge").replace("image/", "other/"), (True, True, True, True)),
    (YES.replace("image/a.png", "example.png"), YES, (True, True, True, True)),
    (YES, "Thought: do i need to use a tool? no\nAI: hello", (False, False, False, False)),
    ("Thought: Do I need to use a tool? No\nAI: a", "Thought: Do I need to use a tool? No\nAI: b", (True, True, True, True)),
    ("", "", (False, True, True, False)),
])
def test_tool_scores(value, expected, said, flags):
    assert tuple(value(scoring.tool_scores(X, Y), x=expected, y=said)) == flags


def test_tool_entry_and_dialogue(value):
    i = "Sys \nPrevious conversation:\nHuman: a\nb\nAI: c\nNew input: do it\nGPT4Tools needs to use tools. Let's think step by step.\nThought: x"
    assert tuple(value(scoring.parse_tool_entry(X, Y), x=i, y=" out ")) == ("Sys", "Human: a\nb\nAI: c", "do it", "Thought: x", "out")
    assert tuple(value(scoring.parse_tool_entry(X, Y), x="only", y=None)) == ("only", "", "", "", "")
    assert [tuple(t) for t in value(scoring.dialogue_turns(X), x="orphan\nHuman: a\nb\nAI: c")] == [("user", "a\nb"), ("assistant", "c")]
    assert value(scoring.dialogue_turns(X), x="") == []


CASES = [
    ("is_rot13_encoded", {}, "Gur png vf va gur ubhfr", True), ("no_plaintext_english", {}, "the and is this", False), ("words_are_reversed", {}, "sirap level", True), ("words_are_reversed", {}, "a an", False),
    ("contains_reversed_paris", {}, "siraP", True), ("at_least_five_animals", {}, "elahw krahs laes barc yar", True), ("no_letter_e", {}, "Abc", True), ("contains_string", {"target": "BC"}, "abc", True),
    ("not_contains_string", {"forbidden": ["x", "B"]}, "abc", False), ("starts_with", {"prefix": "ab"}, "  abc", True), ("ends_with", {"suffix": "c"}, "abc \n", True), ("min_length", {"min_chars": 3}, "abc", True),
    ("sentence_count_range", {"min": 2, "max": 2}, "A b. C d!", True), ("exactly_n_lines", {"n": 2}, "a\n\nb", True), ("sentences_start_alphabetically", {}, "Ant. Bee. Cat.", True), ("sentences_start_alphabetically", {}, "", False),
    ("every_sentence_10_words", {}, "", True), ("acrostic_spells", {"target": "ab"}, "apple\n bee", True), ("exactly_n_paragraphs_with_separator", {"n": 2, "separator": "##"}, "a ## b ##", True),
    ("paragraph_starts_spell", {"letters": "AB", "separator": "##"}, "ant ## bee", True), ("each_paragraph_n_sentences", {"n": 1, "separator": "##"}, "A. ## B.", True), ("every_sentence_has_exactly_one_number", {}, "I have 1. You 22.\n= 3 =", True),
    ("no_word_I", {}, "In it", True), ("syllable_pattern_5_7_5", {}, "an old silent pond\na frog jumps into the pond\nsplash silence again", True), ("consecutive_pairs_rhyme", {}, "the night\nso bright", True), ("consecutive_pairs_rhyme", {}, "one", False),
    ("contains_spanish_markers", {}, "que los", True), ("even_number_of_lines", {}, "", True), ("no_prose_paragraphs", {}, "w " * 26, False), ("min_pirate_terms", {"min_count": 2}, "Arr matey", True), ("matey_at_least_twice", {}, "matey, Matey", True),
    ("all_uppercase", {}, "ABC É!", True), ("exactly_4_sentences", {}, ">>> x\nA. B. C. D.\n<<<", True), ("every_sentence_contains_indeed", {}, "Indeed. No.", False), ("words_reversed_order", {}, "mat the on sat cat The.", True),
    ("every_line_has_timestamp", {}, "[00:00:01.000] a\n[00:00:02.000] b", True), ("timestamps_sequential", {}, "[00:00:02.000] a\n[00:00:01.000] b", False), ("timestamps_sequential", {}, "[00:00:02.000] a", False), ("every_line_has_log_level", {}, "{INFO} a", True),
    ("first_person_perspective", {}, "I, my, ME", True), ("alliterative_sentences", {}, "Big bears bring berries.", True), ("starts_with_index_entry", {}, "INDEX ENTRY #1234 x", True), ("has_classification_line", {}, "CLASSIFICATION: HISTORY", True),
    ("body_has_4_sentences", {}, "BODY: A. B. C. D.\nSEE ALSO: x", True), ("see_also_has_3_terms", {}, "SEE ALSO: a, b,, c", True), ("ends_with_end_entry", {}, "x --- END ENTRY ---\n", True), ("valid_json", {}, ' {"a": 1}', True), ("valid_json", {}, "{", False), ("valid_json", {}, "5 apples", False), ("valid_json", {}, "1, 2", False), ("valid_json", {}, "null", True),
    ("has_exact_keys", {"keys": ["b", "a"]}, '{"a": 1, "b": 2}', True), ("has_exact_keys", {}, "{}", False), ("key_facts_length", {}, '{"key_facts": [1, 2, 3]}', True), ("key_facts_length", {"length": 0}, "{}", True), ("key_facts_length", {}, '{"key_facts": "abc"}', True),
    ("confidence_is_float_in_range", {}, '{"confidence": 0.5}', True), ("confidence_is_float_in_range", {}, '{"confidence": "x"}', False), ("every_sentence_starts_5_letter_word", {}, "Hello you. World it.", True), ("one_caps_word_per_sentence", {}, "This BIG thing. So IS that.", True),
    ("contains_all_fact_markers", {}, ":: FACT 1 :: :: FACT 2 :: :: FACT 3 ::", True), ("simple_vocabulary", {"vocabulary": ["a", "cat"]}, "A cat", True), ("simple_vocabulary", {}, "", False), ("no_technical_jargon", {}, "a programme", False),
    ("no_such_check", {}, "x", False), ("contains_string", {"wrong": 1}, "x", False), ("min_length", {"min_chars": 1}, None, False),
]


def test_checks(spark):
    assert len(CHECKS) == 74
    df = spark.range(1)
    got = df.select(*[check_column(n, F.lit(t).cast("string"), p).alias(f"c{i}") for i, (n, p, t, _) in enumerate(CASES)]).first()
    assert [(CASES[i][0], got[i]) for i in range(len(CASES))] == [(n, ok) for n, _, _, ok in CASES]


def test_run_checks_and_tally(spark):
    df = spark.createDataFrame([("m", "abc"), ("m", None), ("n", "z")], "method string, t string")
    out = {r.method: r for r in tally(run_checks(df, "t", [("no_letter_z", {}), ("min_length", {"min_chars": 1})]), "method").collect()}
    assert (out["m"].total_entries, out["m"].fully_passed, out["m"].passed_checks) == (2, 1, 3) and out["n"].check_pass_rate == 0.5
    none = run_checks(df, "t", []).first()
    assert none.score == 0.0 and none.all_passed


def test_tokens(spark):
    from weftline.functions import tokens

    e = tokens.encoding()
    for t in ("Grüße, мир! 😀", " a  b\n", "it's 1234"):
        assert e.decode(e.encode_ordinary(t)) == t
    df = spark.createDataFrame([(1, ["Hello world", None, ""]), (2, None), (3, [])], "k int, t array<string>")
    assert sorted((r.k, r.tokens) for r in tokens.count_tokens(df, ["k"], F.col("t")).collect()) == [(1, 2), (2, 0), (3, 0)]
    ids = tokens.token_ids(spark.createDataFrame([(1, "Hello world"), (2, None), (3, "")], "k int, t string"), ["k"], F.col("t")).collect()
    assert {r.k: r.ids and e.decode(r.ids) for r in ids} == {1: "Hello world", 2: None, 3: []}
