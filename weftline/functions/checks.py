"""A library of rule checks: name -> predicate over a text.

A check is a function of a text Column and parameters, registered under its name; it gives a boolean Column, and nothing
leaves the JVM. ``run_checks`` evaluates checks that stand in rows, as (name, params) beside the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import count_listed, count_matches, let, letter_count, lines, rhymes, rot13, sentences, stamp_millis, strict_json, strip, syllables, tokens, word_count, words_of

CHECKS: dict[str, Callable[..., Column]] = {}

# The words that checks look for, as they are given.
ROT13_WORDS = "the is are and of to in a that it for was on with"
PLAIN_WORDS = "the and are is this that with from have color three primary which they there"
COLOURS = "red blue yellow green"
PHOTOSYNTHESIS = "photosynthesis plant sunlight chloro oxygen carbon"
REVERSED_SKIP = "a an the of in on at to for and but or is was are were i it"
REVERSED_ANIMALS = "nihplod elahs elahw supotco hsifyllej eltrut krahs"
CONTENT_WORDS = "capital france paris city country dolphin whale shark turtle ocean animal"
ANIMALS = "dolphin whale shark octopus jellyfish turtle seal crab lobster starfish seahorse ray squid eel clam shrimp walrus penguin orca"
ENGLISH_WORDS = "the is are and but with for that this have from they their about which would there these could should being because between through before after during"
SPANISH_WORDS = "que los las del por una con para como más pero esta ese son hay"
AGAINST_DEMOCRACY = "weakness flaw inferior tyranny ignorance slow manipulat danger problem fail susceptib demagog"
FOR_SOCIAL_MEDIA = "benefit positive transform democrat connect empower innovat communit access opportunit"
AGREEMENT = ["you have a point", "that is true", "i agree", "you are right", "you're right", "that's true", "partly true", "you make a good point"]
PIRATE = "arr matey ye scallywag landlubber plunder booty doubloons swab bilge scurvy blimey avast ahoy aye treasure galleon cutlass barnacle gangplank"
NORMAL_WORDS = "the is are and of to in was on that not can light blue air sun how this plants water use"
SENSATIONS = "warm cold hot heat cool weight heavy held grip touch ceramic temperature vibrat chill pour fill liquid steam"
ALLITERATION_SKIP = "a an the of in on at to for and but or is was are were by with from as its it that this than"
CLASSIFICATIONS = "SCIENCE HISTORY CULTURE TECHNOLOGY NATURE"
FACT_MARKERS = [":: FACT 1 ::", ":: FACT 2 ::", ":: FACT 3 ::"]
OMNI_MARKERS = [">>> OMNI OUTPUT <<<", "<<< END OMNI >>>"]
JARGON = (
    "engine piston combustion cylinder crankshaft fuel gasoline ignition throttle exhaust carburetor transmission horsepower virus malware software hardware program "
    "install download internet network antivirus firewall trojan phishing ransomware"
)
SEPARATOR = "🔹🔹🔹"


def check(f: Callable[..., Column]) -> Callable[..., Column]:
    CHECKS[f.__name__] = f
    return f


def _held(words: Column, listed: str) -> Column:
    """How many of the listed words are among ``words``."""
    return F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in listed.split()])))


def _letters(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("[A-Za-z]+"), F.lit(0))


def _paragraphs(x: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(x, rf"\Q{separator}\E"), strip), lambda p: p != "")


def _initials(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.upper(F.substring(strip(p), 1, 1))), "")


def _without(x: Column, markers: list[str]) -> Column:
    for m in markers:
        x = F.replace(x, F.lit(m), F.lit(""))
    return strip(x)


def _json(x: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(strict_json(strip(x)), path, kind)


def _plain(name: str, f: Callable[[Column], Column]) -> None:
    CHECKS[name] = f


# texts that are encoded or reversed
_plain("is_rot13_encoded", lambda x: _held(F.array_distinct(tokens(F.lower(rot13(x)))), ROT13_WORDS) >= 3)
_plain("no_plaintext_english", lambda x: _held(words_of(x), PLAIN_WORDS) <= 2)
_plain("mentions_colors_when_decoded", lambda x: count_listed(F.lower(rot13(x)), COLOURS.split()) >= 2)
_plain("decoded_mentions_photosynthesis", lambda x: count_listed(F.lower(rot13(x)), PHOTOSYNTHESIS.split()) >= 2)
_plain("contains_reversed_paris", lambda x: F.contains(F.lower(x), F.lit("sirap")))
_plain("contains_reversed_animals", lambda x: count_listed(F.lower(x), REVERSED_ANIMALS.split()) >= 3)
_plain("no_normal_english_content_words", lambda x: _held(words_of(x), CONTENT_WORDS) <= 1)
_plain("at_least_five_animals", lambda x: _held(F.array_distinct(F.transform(_letters(x), lambda w: F.lower(F.reverse(w)))), ANIMALS) >= 5)
_plain("individual_words_spelled_normally", lambda x: _held(words_of(x), NORMAL_WORDS) >= 2)


@check
def words_are_reversed(x: Column) -> Column:
    """Half or more of the content words are no palindromes; false without content words."""
    w = F.filter(F.transform(_letters(x), F.lower), lambda w: (F.length(w) > 2) & ~w.isin(REVERSED_SKIP.split()))
    return (F.size(w) > 0) & (F.size(F.filter(w, lambda w: w != F.reverse(w))) * 2 >= F.size(w))


@check
def words_reversed_order(x: Column) -> Column:
    """At least half of the sentences, rounded down, have three words or more and a capital in the last two."""
    s = sentences(x)

    def capital(w: Column) -> Column:
        first = F.substring(w, 1, 1)
        return F.rlike(first, F.lit(r"\p{Lu}"))

    looks = F.filter(s, lambda t: (word_count(t) >= 3) & F.exists(F.slice(tokens(t), -2, 2), capital))
    return F.size(looks) >= F.floor(F.size(s) / 2)


# letters and strings
_plain("no_letter_e", lambda x: F.instr(F.lower(x), "e") == 0)
_plain("no_letter_z", lambda x: F.instr(F.lower(x), "z") == 0)
_plain("no_word_I", lambda x: count_matches(x, r"(?U)\bI\b") == 0)
_plain("all_uppercase", lambda x: count_matches(x, "[a-z]") == 0)
_plain("no_question_marks", lambda x: F.instr(x, "?") == 0)
_plain("ends_with_exclamation", lambda x: F.endswith(strip(x), F.lit("!")))
_plain("has_warn_or_error", lambda x: F.rlike(x, F.lit(r"\{(WARN|ERROR)\}")))
_plain("starts_with_index_entry", lambda x: F.rlike(strip(x), F.lit(r"(?U)^INDEX ENTRY #\d{4}")))
_plain("ends_with_end_entry", lambda x: F.endswith(strip(x), F.lit("--- END ENTRY ---")))
_plain("contains_all_fact_markers", lambda x: count_listed(x, FACT_MARKERS) == 3)
_plain("no_technical_jargon", lambda x: count_listed(F.lower(x), JARGON.split()) == 0)
_plain("no_agreement_phrases", lambda x: count_listed(F.lower(x), AGREEMENT) == 0)
_plain("disagrees_with_democracy", lambda x: count_listed(F.lower(x), AGAINST_DEMOCRACY.split()) >= 2)
_plain("defends_social_media", lambda x: count_listed(F.lower(x), FOR_SOCIAL_MEDIA.split()) >= 2)
_plain("references_physical_sensation", lambda x: count_listed(F.lower(x), SENSATIONS.split()) >= 1)
_plain("matey_at_least_twice", lambda x: count_matches(F.lower(x), r"(?U)\bmatey\b") >= 2)
_plain("first_person_perspective", lambda x: count_matches(x, r"(?iU)\b(?:I|my|me|myself)\b") >= 3)
_plain("no_english_words", lambda x: _held(words_of(x), ENGLISH_WORDS) <= 1)
_plain("contains_spanish_markers", lambda x: F.rlike(x, F.lit("[áéíóúñ¿¡]")) | (_held(words_of(x, "a-záéíóúñ"), SPANISH_WORDS) >= 2))
_plain("topically_relevant", lambda x: F.lit(True))


@check
def contains_string(x: Column, target: str = "") -> Column:
    return F.contains(F.lower(x), F.lit(target.lower()))


@check
def not_contains_string(x: Column, forbidden: list[str] | None = None) -> Column:
    return count_listed(F.lower(x), [f.lower() for f in forbidden or []]) == 0


@check
def starts_with(x: Column, prefix: str = "") -> Column:
    return F.startswith(strip(x), F.lit(prefix))


@check
def ends_with(x: Column, suffix: str = "") -> Column:
    return F.endswith(strip(x), F.lit(suffix))


@check
def min_pirate_terms(x: Column, min_count: int = 5, terms: list[str] | None = None) -> Column:
    """Terms are regular expressions between word boundaries, each counted once."""
    hits = F.lit(0)
    for t in terms or PIRATE.split():
        hits = hits + F.rlike(F.lower(x), F.lit(rf"(?U)\b{t}\b")).cast("int")
    return hits >= min_count


@check
def simple_vocabulary(x: Column, vocabulary: list[str] | None = None, share: float = 0.85) -> Column:
    """At least ``share`` of the words are in the vocabulary, which is the caller's; false without words."""
    w = F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0))
    known = F.array(*[F.lit(v) for v in vocabulary or []]).cast("array<string>")
    return (F.size(w) > 0) & (F.size(F.filter(w, lambda t: F.array_contains(known, t))) >= share * F.size(w))


# counts
_plain("exactly_three_lines", lambda x: F.size(lines(x)) == 3)
_plain("no_extra_text", lambda x: F.size(lines(x)) <= 3)
_plain("even_number_of_lines", lambda x: F.size(lines(x)) % 2 == 0)
_plain("exactly_5_sentences", lambda x: F.size(sentences(x)) == 5)
_plain("every_sentence_10_words", lambda x: F.forall(sentences(x), lambda s: word_count(s) == 10))
_plain("every_sentence_contains_indeed", lambda x: F.forall(sentences(x), lambda s: F.contains(F.lower(s), F.lit("indeed"))))
_plain("no_prose_paragraphs", lambda x: F.forall(lines(x), lambda s: word_count(s) <= 25))


@check
def min_length(x: Column, min_chars: int = 100) -> Column:
    return F.length(x) >= min_chars


@check
def min_sentences(x: Column, min_count: int = 3) -> Column:
    return F.size(sentences(x)) >= min_count


@check
def min_lines(x: Column, min_count: int = 6) -> Column:
    return F.size(lines(x)) >= min_count


@check
def exactly_n_lines(x: Column, n: int = 9) -> Column:
    return F.size(lines(x)) == n


@check
def sentence_count_range(x: Column, min: int = 3, max: int = 7) -> Column:
    return F.size(sentences(x)).between(min, max)


@check
def line_count_range(x: Column, min: int = 5, max: int = 8) -> Column:
    return F.size(lines(x)).between(min, max)


@check
def each_line_min_words(x: Column, min_words: int = 6) -> Column:
    return F.forall(lines(x), lambda s: word_count(s) >= min_words)


@check
def exactly_4_sentences(x: Column) -> Column:
    """Lines that begin with >>> or <<< are no part of the body if both signs occur."""
    body = F.filter(F.split(strip(x), "\n"), lambda s: ~F.rlike(strip(s), F.lit("^(>>>|<<<)")))
    marked = F.contains(x, F.lit(">>>")) & F.contains(x, F.lit("<<<"))
    return F.size(sentences(F.when(marked, F.array_join(body, " ")).otherwise(x))) == 4


# sentences and lines in order
@check
def sentences_start_alphabetically(x: Column) -> Column:
    """The i-th sentence begins with the i-th letter, beginning again after Z; false without sentences."""
    right = F.transform(sentences(x), lambda s, i: F.upper(F.substring(s, 1, 1)) == F.chr(F.lit(65) + i % 26))
    return (F.size(right) > 0) & F.forall(right, lambda r: r)


@check
def acrostic_spells(x: Column, target: str = "") -> Column:
    return _initials(lines(x)) == target.upper()


@check
def exactly_n_paragraphs_with_separator(x: Column, n: int = 5, separator: str = SEPARATOR) -> Column:
    return F.size(_paragraphs(x, separator)) == n


@check
def paragraph_starts_spell(x: Column, letters: str = "FSTFF", separator: str = SEPARATOR) -> Column:
    return _initials(_paragraphs(x, separator)) == letters.upper()


@check
def each_paragraph_n_sentences(x: Column, n: int = 3, separator: str = SEPARATOR) -> Column:
    return F.forall(_paragraphs(x, separator), lambda p: F.size(sentences(p)) == n)


@check
def every_sentence_has_exactly_one_number(x: Column) -> Column:
    """Lines that begin with = don't count."""
    body = F.array_join(F.filter(F.split(strip(x), "\n"), lambda s: ~F.startswith(strip(s), F.lit("="))), "\n")
    return F.forall(sentences(body), lambda s: count_matches(s, r"(?U)\d+") == 1)


@check
def syllable_pattern_5_7_5(x: Column) -> Column:
    """Three lines of about 5, 7 and 5 syllables, one more or less each."""
    n = F.transform(lines(x), lambda s: F.aggregate(_letters(s), F.lit(0), lambda a, w: a + syllables(w)))
    near = lambda i, want: F.abs(F.get(n, i) - want) <= 1
    return (F.size(n) == 3) & F.coalesce(near(0, 5) & near(1, 7) & near(2, 5), F.lit(False))


@check
def consecutive_pairs_rhyme(x: Column) -> Column:
    """Of the pairs of lines (1, 2), (3, 4) ... three fifths or more rhyme; false with fewer than two lines."""
    last = F.transform(lines(x), lambda s: F.coalesce(F.lower(F.try_element_at(_letters(s), F.lit(-1))), F.lit("")))

    def enough(last: Column) -> Column:
        pairs = F.floor(F.size(last) / 2).cast("int")
        good = F.size(F.filter(F.sequence(F.lit(1), F.greatest(pairs, F.lit(1))), lambda i: F.coalesce(rhymes(F.get(last, 2 * i - 2), F.get(last, 2 * i - 1)), F.lit(False))))
        return (pairs > 0) & (good * 5 >= pairs * 3)

    return let(last, enough)


@check
def alliterative_sentences(x: Column) -> Column:
    """In seven of ten sentences or more, three fifths of three or more major words begin with the same letter."""

    def good(t: Column) -> Column:
        first = F.transform(F.filter(_letters(t), lambda w: (F.length(w) > 1) & ~F.lower(w).isin(ALLITERATION_SKIP.split())), lambda w: F.lower(F.substring(w, 1, 1)))
        return let(first, same)

    def same(first: Column) -> Column:
        most = F.array_max(F.transform(F.array_distinct(first), lambda c: F.size(F.filter(first, lambda d: d == c))))
        return (F.size(first) >= 3) & (most * 5 >= F.size(first) * 3)

    return let(sentences(x), lambda s: F.size(F.filter(s, good)) * 10 >= F.size(s) * 7)


@check
def every_sentence_starts_5_letter_word(x: Column) -> Column:
    return F.forall(sentences(_without(x, OMNI_MARKERS)), lambda s: letter_count(F.get(tokens(s), 0)) == 5)


@check
def one_caps_word_per_sentence(x: Column) -> Column:
    caps = lambda w: F.rlike(w, F.lit(r"^\p{L}{2,}$")) & (w == F.upper(w)) & (w != F.lower(w))
    return F.forall(sentences(_without(x, OMNI_MARKERS)), lambda s: F.size(F.filter(tokens(s), caps)) == 1)


# logs and entries
_plain("every_line_has_timestamp", lambda x: F.forall(lines(x), lambda s: stamp_millis(strip(s)).isNotNull()))
_plain("every_line_has_log_level", lambda x: F.forall(lines(x), lambda s: F.rlike(s, F.lit(r"\{(INFO|WARN|ERROR)\}"))))


@check
def timestamps_sequential(x: Column) -> Column:
    """The stamps of lines that have one increase strictly; false with fewer than two."""
    t = F.filter(F.transform(lines(x), lambda s: stamp_millis(strip(s))), lambda m: m.isNotNull())

    def rising(t: Column) -> Column:
        return (F.size(t) >= 2) & F.forall(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda i: F.coalesce(F.get(t, i - 1) < F.get(t, i), F.lit(True)))

    return let(t, rising)


_plain("has_classification_line", lambda x: F.regexp_extract(x, r"(?U)CLASSIFICATION:\s*(\w+)", 1).isin(CLASSIFICATIONS.split()))


@check
def body_has_4_sentences(x: Column) -> Column:
    body = r"(?s)BODY:\s*(.*?)(?=\nSEE ALSO:)"
    return F.rlike(x, F.lit(body)) & (F.size(sentences(F.regexp_extract(x, body, 1))) == 4)


@check
def see_also_has_3_terms(x: Column) -> Column:
    terms = F.filter(F.transform(F.split(F.regexp_extract(x, r"SEE ALSO:\s*(.*?)(?=\n|\z)", 1), ","), strip), lambda t: t != "")
    return F.size(terms) == 3


# JSON
_plain("valid_json", lambda x: strict_json(strip(x)).isNotNull())


@check
def has_exact_keys(x: Column, keys: list[str] | None = None) -> Column:
    if not keys:
        return F.lit(False)
    got = F.json_object_keys(F.when(strict_json(strip(x)).isNotNull(), strip(x)))
    want = F.array(*[F.lit(k) for k in sorted(set(keys))])
    return F.coalesce(F.array_sort(F.array_distinct(got)) == want, F.lit(False))


def _holds(x: Column, key: str, length: int) -> Column:
    """An array, object or string under a key has that length; a missing key has none."""
    size = F.coalesce(F.size(_json(x, f"$.{key}", "array<variant>")), F.lit(-1))
    n = F.when(size >= 0, size).otherwise(F.coalesce(F.size(_json(x, f"$.{key}", "map<string,variant>")), F.lit(-1)))
    text = _json(x, f"$.{key}", "string")
    missing = _json(x, "$", "map<string,variant>").isNotNull() & _json(x, f"$.{key}", "variant").isNull()
    return F.coalesce(F.when(missing, F.lit(0) == length).when(n >= 0, n == length).otherwise(F.length(text) == length), F.lit(False))


@check
def key_facts_length(x: Column, key: str = "key_facts", length: int = 3) -> Column:
    return _holds(x, key, length)


@check
def related_topics_length(x: Column, key: str = "related_topics", length: int = 2) -> Column:
    return _holds(x, key, length)


@check
def confidence_is_float_in_range(x: Column) -> Column:
    """A number, or a boolean taken as one, from 0 to 1."""
    kind = F.schema_of_variant(_json(x, "$.confidence", "variant"))
    number = _json(x, "$.confidence", "double")
    return F.coalesce(((kind == "BOOLEAN") | F.rlike(kind, F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))) & number.between(0.0, 1.0), F.lit(False))


# --- the engine around them ---


def check_column(name: str, x: Column, params: dict | None = None) -> Column:
    """The result of a check, false for a null text, an unknown name and parameters it doesn't have."""
    f = CHECKS.get(name)
    if f is None:
        return F.lit(False)
    try:
        return F.coalesce(f(F.coalesce(x, F.lit("")), **(params or {})), F.lit(False))
    except TypeError:
        return F.lit(False)


def run_checks(df: DataFrame, text: str, checks: list[tuple[str, dict]]) -> DataFrame:
    """``df`` with total_checks, passed_checks, score and all_passed for the given checks of ``text``; without checks the
    score is 0 and all have passed."""
    passed = F.lit(0)
    for name, params in checks:
        passed = passed + check_column(name, F.col(text), params).cast("int")
    n = len(checks)
    out = df.withColumn("passed_checks", passed).withColumn("total_checks", F.lit(n))
    return out.withColumn("score", F.col("passed_checks") / n if n else F.lit(0.0)).withColumn("all_passed", F.col("passed_checks") == n)


def run_checks_in_rows(df: DataFrame, entry: str, text: str, name: str, params: str, known: list[tuple[str, dict]]) -> DataFrame:
    """(entry, name, passed) where each row names its check and its parameters, as JSON text.

    ``known`` lists the pairs that occur; each becomes one branch of a CASE, so no check runs on rows of another. Rows
    with other pairs have failed.
    """
    import json

    hit = F.lit(None).cast("boolean")
    branch = None
    for n, p in known:
        when = (F.col(name) == n) & (F.coalesce(F.col(params), F.lit("{}")) == json.dumps(p, sort_keys=True))
        value = check_column(n, F.col(text), p)
        branch = F.when(when, value) if branch is None else branch.when(when, value)
    return df.select(entry, name, F.coalesce(branch if branch is not None else hit, F.lit(False)).alias("passed"))


def tally(results: DataFrame, method: str) -> DataFrame:
    """Per method: entries, fully passed ones, checks, passed ones, and both rates. Takes rows with total_checks,
    passed_checks and all_passed; a method without checks has a check rate of 0."""
    g = results.groupBy(method).agg(
        F.count("*").alias("total_entries"), F.count_if("all_passed").alias("fully_passed"), F.sum("total_checks").alias("total_checks"), F.sum("passed_checks").alias("passed_checks")
    )
    return g.withColumn("entry_pass_rate", F.col("fully_passed") / F.col("total_entries")).withColumn("check_pass_rate", F.when(F.col("total_checks") > 0, F.col("passed_checks") / F.col("total_checks")).otherwise(0.0))
