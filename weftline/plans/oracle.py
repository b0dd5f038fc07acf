"""For each query that SQL can express exactly, the same in DuckDB's SQL over the same tables.

RE2 has ASCII classes and neither lookaround nor backreferences, so white space and word boundaries are spelled out.
"""

from __future__ import annotations

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CUT = "\x01"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '{WS}+'), lambda t: t != '')"


def words(x: str) -> str:
    return f"len({tokens(x)})"


def normalize(x: str) -> str:
    bare = rf"regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g')"
    for _ in range(3):  # neighbours share the boundary, so a pass may miss every other article
        bare = rf"regexp_replace({bare}, '(^|[^\pL\pN_])(a|an|the)($|[^\pL\pN_])', '\1 \3', 'g')"
    return f"array_to_string({tokens(bare)}, ' ')"


def sentences(x: str) -> str:
    marked = rf"regexp_replace({strip(x)}, '([.!?]){WS}+', '\1{CUT}', 'g')"
    return f"list_filter(list_transform(string_split({marked}, '{CUT}'), lambda t: {strip('t')}), lambda t: t != '')"


def lines(x: str) -> str:
    return f"list_filter(string_split({strip(x)}, chr(10)), lambda t: {strip('t')} != '')"


def overlap(g: str, p: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct(list_intersect({g}, {p})), lambda w: least(len(list_filter({g}, lambda y: y = w)), len(list_filter({p}, lambda z: z = w))))), 0)"


def harmonic(common: str, g: str, p: str) -> str:
    return f"CASE WHEN {common} = 0 THEN 0.0 ELSE 2.0 * {common}::DOUBLE / (len({g}) + len({p})) END"


def f1_table(src: str, keys: str, gold: str, said: str) -> str:
    """A subquery (keys, g, p, common) over src."""
    return f"""(SELECT *, {overlap('g', 'p')} AS common FROM (SELECT {keys}, {tokens(normalize(f"coalesce({gold}, '')"))} AS g, {tokens(normalize(f"coalesce({said}, '')"))} AS p FROM {src}))"""


TOKEN_F1 = f"CASE WHEN len(g) = 0 OR len(p) = 0 THEN (len(g) = len(p))::INT::DOUBLE ELSE {harmonic('common', 'g', 'p')} END"


def seeded(x: str, seed: int) -> str:
    return f"md5(concat({x}, '#{seed}'))"


def last(src: str, key: str, order: str, cols: str = "*") -> str:
    return f"(SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order} DESC) AS rn FROM {src}) WHERE rn = 1)"


QUESTIONS = """(SELECT system_prompt_id, q.id AS question_id, q.question AS question, coalesce(q.type, 'on_topic') AS question_type,
    coalesce(q.difficulty, '') AS question_difficulty, coalesce(len(q.tags), 0) AS tags FROM (SELECT system_prompt_id, unnest(questions) AS q FROM questions))"""
MESSAGES = "(SELECT item_id, dataset, i - 1 AS pos, conversations[i].role AS role, conversations[i].content AS content, conversations[i + 1].role AS next_role, conversations[i + 1].content AS next FROM (SELECT item_id, dataset, conversations, unnest(range(1, len(conversations) + 1)) AS i FROM ift_data_pwc))"
PAIRS = f"(SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY pos) - 1 AS pos, content AS question, next AS answer FROM {MESSAGES} WHERE role = 'user' AND next_role = 'assistant')"
GOOD = "context IS NOT NULL AND conversations IS NOT NULL"
OFF = "coalesce(question_type = 'off_topic', false) OR coalesce(TRY_CAST(list_last(string_split(question_id, '_q')) AS INT) >= 11, false)"


def think(variant: str) -> str:
    low = "lower(raw_response)"
    label = lambda x: strip(rf"regexp_replace({x}, '^(final answer|answer)\s*:\s*', '', 'i')")
    first = lambda x: f"coalesce(list_filter(list_transform(string_split_regex({x}, '\\r\\n|[\\n\\r\\x{{0b}}\\x{{0c}}\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda t: {strip('t')}), lambda t: t != '')[1], {x})"
    if variant in ("plain", "tools"):
        rest = "substr(raw_response, s + 7)"
        e = f"strpos({rest}, '</think>')"
        t = f"CASE WHEN s = 0 THEN '' WHEN {e} > 0 THEN {strip(f'substr({rest}, 1, {e} - 1)')} ELSE {strip(rest)} END"
        a = f"CASE WHEN s = 0 THEN {strip('raw_response')} WHEN {e} > 0 THEN {strip(f'substr({rest}, {e} + 8)')} ELSE '' END"
        a = label(f"({a})") if variant == "plain" else a
        return f"SELECT DISTINCT question_id, loaded_at, CASE WHEN raw_response IS NOT NULL THEN {t} END AS think, CASE WHEN raw_response IS NOT NULL THEN {a} END AS answer FROM (SELECT *, strpos(raw_response, '<think>') AS s FROM responses_32b)"
    inside, after, good = strip("substr(raw_response, s + 7, e - s - 7)"), strip("substr(raw_response, e + 8)"), "(s > 0 AND e > s)"
    if variant == "responses":
        t = f"CASE WHEN e = 0 THEN '' WHEN {good} THEN {inside} ELSE '[error]' END"
        a = f"CASE WHEN s = 0 AND e = 0 THEN {strip('raw_response')} WHEN e = 0 THEN {strip('substr(raw_response, s + 7)')} WHEN {good} THEN {after} ELSE raw_response END"
    elif variant == "qa":
        bare = strip(r"regexp_replace(raw_response, '(?is)<think>.*?</think>\s*', '', 'g')")
        t = f"CASE WHEN {good} THEN {inside} ELSE '' END"
        a = first(label(f"(CASE WHEN {good} THEN {after} ELSE {bare} END)"))
    else:
        led = "((s > 0) != (e > 0) AND starts_with(raw_response, '<think>' || chr(10)))"
        wrong = "((s > 0) != (e > 0) OR (s > 0 AND e < s))"
        t = f"CASE WHEN {led} THEN '' WHEN {wrong} THEN '[error]' WHEN {good} THEN {inside} ELSE '' END"
        fine = first(label(f"(CASE WHEN {good} THEN {after} ELSE {strip('raw_response')} END)"))
        a = f"CASE WHEN {led} THEN {strip('substr(raw_response, 9)')} WHEN {wrong} THEN raw_response ELSE {fine} END"
    return f"SELECT DISTINCT question_id, loaded_at, CASE WHEN raw_response IS NOT NULL THEN {t} END AS think, CASE WHEN raw_response IS NOT NULL THEN {a} END AS answer FROM (SELECT *, strpos({low}, '<think>') AS s, strpos({low}, '</think>') AS e FROM responses_32b)"


def _call(x: str) -> dict[str, str]:
    one = lambda p, o="": f"nullif({strip(f'regexp_extract({x}, {chr(39)}{o}{p}{chr(39)}, 1)')}, '')"
    return {
        "thought_yes": f"lower({one(r'Thought:\s*Do I need to use a tool\?\s*(Yes|No)', '(?i)')}) = 'yes'", "action": one(r"Action:\s*(.+?)(?:\n|$)"), "action_input": one(r"Action Input:\s*(.+?)(?:\n|$)"),
        "ai_response": one(r"AI:\s*(.+?)(?:\n|$)", "(?s)"),
    }


def _scores() -> str:
    e = ", ".join(f"{v} AS e_{k}" for k, v in _call("text").items())
    m = ", ".join(f"{v} AS m_{k}" for k, v in _call("said").items())
    base = lambda x: f"list_last(string_split({x}, '/'))"
    ei, mi = "lower(e_action_input)", "lower(m_action_input)"
    return f"""WITH n AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE kind = 'tool'),
    pair AS (SELECT a.doc_id, a.text, b.text AS said FROM n a JOIN n b ON a.k + 1 = b.k),
    c AS (SELECT doc_id, {e}, {m} FROM pair),
    s AS (SELECT doc_id, coalesce(NOT e_thought_yes AND NOT m_thought_yes, false) AS declined, coalesce(e_thought_yes = m_thought_yes, false) AS thought,
        coalesce(lower(e_action) = lower(m_action), false) OR (e_action IS NULL AND m_action IS NULL) AS action0,
        coalesce(CASE WHEN {ei} = 'example.png' THEN {mi} != '' ELSE {ei} = {mi} OR {base(ei)} = {base(mi)} END, false) OR (e_action_input IS NULL AND m_action_input IS NULL) AS args0 FROM c)
    SELECT doc_id, thought, declined OR action0 AS action, declined OR args0 AS args, thought AND (declined OR action0) AND (declined OR args0) AS "full" FROM s"""


def _shares(x: str, listed: list[str]) -> str:
    return " + ".join(f"contains({x}, '{w}')::INT" for w in listed)


def _checks() -> dict[str, str]:
    from ..functions import checks as c

    held = lambda x, listed: f"len(list_intersect({x}, {listed.split()!r}))"
    # words between boundaries that know all letters and digits
    plain = f"list_filter(list_distinct(string_split_regex(lower(a), '[^\\pL\\pN_]+')), lambda w: regexp_full_match(w, '[a-z]+'))"
    spanish = f"list_filter(list_distinct(string_split_regex(lower(a), '[^\\pL\\pN_]+')), lambda w: regexp_full_match(w, '[a-záéíóúñ]+'))"
    return {
        "min_length": "length(a) >= 100", "min_sentences": f"len({sentences('a')}) >= 3", "no_letter_z": "strpos(lower(a), 'z') = 0", "no_question_marks": "strpos(a, '?') = 0", "ends_with_exclamation": f"ends_with({strip('a')}, '!')",
        "contains_string": "contains(lower(a), 'the')", "no_technical_jargon": f"({_shares('lower(a)', c.JARGON.split())}) = 0", "references_physical_sensation": f"({_shares('lower(a)', c.SENSATIONS.split())}) >= 1",
        "exactly_three_lines": f"len({lines('a')}) = 3", "even_number_of_lines": f"len({lines('a')}) % 2 = 0", "no_prose_paragraphs": f"len(list_filter({lines('a')}, lambda l: {words('l')} > 25)) = 0",
        "no_plaintext_english": f"{held(plain, c.PLAIN_WORDS)} <= 2", "all_uppercase": "NOT regexp_matches(a, '[a-z]')", "contains_spanish_markers": f"regexp_matches(a, '[áéíóúñ¿¡]') OR {held(spanish, c.SPANISH_WORDS)} >= 2",
    }


def _more_checks() -> dict[str, str]:
    from ..functions import checks as c

    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rot = f"translate(a, '{up + up.lower()}', '{(up[13:] + up[:13]) + (up[13:] + up[:13]).lower()}')"
    plain = "list_filter(list_distinct(string_split_regex(lower(a), '[^\\pL\\pN_]+')), lambda w: regexp_full_match(w, '[a-z]+'))"
    held = lambda x, listed: f"len(list_intersect({x}, {listed.split()!r}))"
    word = lambda x, w: f"len(regexp_extract_all(regexp_replace({x}, '([^\\pL\\pN_])', '\\1\\1', 'g'), '(^|[^\\pL\\pN_])({w})($|[^\\pL\\pN_])'))"
    letters = "regexp_extract_all(a, '[A-Za-z]+')"
    rev = lambda w: f"array_to_string(list_reverse(string_split({w}, '')), '')"
    content = f"list_filter(list_transform({letters}, lambda w: lower(w)), lambda w: length(w) > 2 AND NOT list_contains({c.REVERSED_SKIP.split()!r}, w))"
    se, li = sentences("a"), lines("a")
    paras = f"list_filter(list_transform(string_split(a, chr(10) || chr(10)), lambda p: {strip('p')}), lambda p: p != '')"
    listed = lambda x: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in x) + "]"
    held_text = lambda x, ws: f"len(list_filter({listed(ws)}, lambda k: contains({x}, k)))"
    known = "regexp_extract_all(lower(a), '[a-z]+')"
    return {
        "is_rot13_encoded": f"{held(f'list_distinct({tokens(f'lower({rot})')})', c.ROT13_WORDS)} >= 3", "mentions_colors_when_decoded": f"{held_text(f'lower({rot})', c.COLOURS.split())} >= 2",
        "decoded_mentions_photosynthesis": f"{held_text(f'lower({rot})', c.PHOTOSYNTHESIS.split())} >= 2", "contains_reversed_paris": "contains(lower(a), 'sirap')", "contains_reversed_animals": f"{held_text('lower(a)', c.REVERSED_ANIMALS.split())} >= 3",
        "no_normal_english_content_words": f"{held(plain, c.CONTENT_WORDS)} <= 1", "at_least_five_animals": f"{held(f'list_distinct(list_transform({letters}, lambda w: lower({rev(chr(119))})))', c.ANIMALS)} >= 5",
        "individual_words_spelled_normally": f"{held(plain, c.NORMAL_WORDS)} >= 2", "words_are_reversed": f"len({content}) > 0 AND 2 * len(list_filter({content}, lambda w: w != {rev('w')})) >= len({content})",
        "no_letter_e": "strpos(lower(a), 'e') = 0", "no_word_I": f"{word('a', 'I')} = 0", "has_warn_or_error": "regexp_matches(a, '\\{(WARN|ERROR)\\}')", "starts_with_index_entry": f"regexp_matches({strip('a')}, '^INDEX ENTRY #[0-9]{{4}}')",
        "ends_with_end_entry": f"ends_with({strip('a')}, '--- END ENTRY ---')", "contains_all_fact_markers": f"{held_text('a', c.FACT_MARKERS)} = 3", "no_agreement_phrases": f"{held_text('lower(a)', c.AGREEMENT)} = 0",
        "disagrees_with_democracy": f"{held_text('lower(a)', c.AGAINST_DEMOCRACY.split())} >= 2", "defends_social_media": f"{held_text('lower(a)', c.FOR_SOCIAL_MEDIA.split())} >= 2", "matey_at_least_twice": f"{word('lower(a)', 'matey')} >= 2",
        "first_person_perspective": f"{word('lower(a)', 'i|my|me|myself')} >= 3", "no_english_words": f"{held(plain, c.ENGLISH_WORDS)} <= 1", "not_contains_string": "NOT contains(lower(a), 'winch') AND NOT contains(lower(a), 'ledger')",
        "starts_with": f"starts_with({strip('a')}, 'The ')", "ends_with": f"ends_with({strip('a')}, '.')", "min_lines": f"len({li}) >= 6", "exactly_n_lines": f"len({li}) = 3", "sentence_count_range": f"len({se}) BETWEEN 3 AND 7", "line_count_range": f"len({li}) BETWEEN 5 AND 8",
        "each_line_min_words": f"len(list_filter({li}, lambda l: {words('l')} < 6)) = 0", "exactly_5_sentences": f"len({se}) = 5", "every_sentence_10_words": f"len(list_filter({se}, lambda l: {words('l')} != 10)) = 0",
        "every_sentence_contains_indeed": f"len(list_filter({se}, lambda l: NOT contains(lower(l), 'indeed'))) = 0", "no_extra_text": f"len({li}) <= 3", "acrostic_spells": f"array_to_string(list_transform({li}, lambda l: upper({strip('l')}[1])), '') = 'T'",
        "exactly_n_paragraphs_with_separator": f"len({paras}) = 2", "each_paragraph_n_sentences": f"len(list_filter({paras}, lambda p: len({sentences('p')}) != 2)) = 0",
        "every_line_has_timestamp": f"len(list_filter({li}, lambda l: NOT regexp_matches({strip('l')}, '^\\[[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}\\.[0-9]{{3}}\\]'))) = 0", "every_line_has_log_level": f"len(list_filter({li}, lambda l: NOT regexp_matches(l, '\\{{(INFO|WARN|ERROR)\\}}'))) = 0",
        "has_classification_line": f"list_contains({c.CLASSIFICATIONS.split()!r}, regexp_extract(a, 'CLASSIFICATION:\\s*([\\pL\\pN_]+)', 1))", "valid_json": f"json_valid({strip('a')})", "min_pirate_terms": f"len(list_intersect(list_distinct(string_split_regex(lower(a), '[^\\pL\\pN_]+')), {c.PIRATE.split()!r})) >= 1",
        "topically_relevant": "true", "every_sentence_starts_5_letter_word": f"len(list_filter({se}, lambda l: length(regexp_replace(({tokens('l')})[1], '[^\\pL]', '', 'g')) != 5)) = 0",
        "sentences_start_alphabetically": f"len({se}) > 0 AND len(list_filter(range(1, len({se}) + 1), lambda i: upper(({se})[i][1]) != chr((65 + (i - 1) % 26)::INT))) = 0",
        "simple_vocabulary": f"len({known}) > 0 AND len(list_filter({known}, lambda w: list_contains(['the', 'of', 'and', 'a', 'in'], w))) >= 0.2 * len({known})",
    }


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    t = "text"
    q["text_counts"] = f"SELECT doc_id, {words(t)} AS words, CAST(({words(t)} * 13 + 9) // 10 AS BIGINT) AS approx_tokens, len({sentences(t)}) AS sentences, len({lines(t)}) AS lines, length(regexp_replace({t}, '[^\\pL]', '', 'g')) AS letters FROM documents"
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rot = up[13:] + up[:13]
    q["text_rewrites"] = f"""SELECT id, generation_batch, translate(system_prompt, '{up + up.lower()}', '{rot + rot.lower()}') AS rot13, concat(upper(system_prompt[1]), system_prompt[2:]) AS capital,
        regexp_replace(system_prompt, '[^A-Za-z0-9]', '_', 'g') AS file_name, CASE WHEN length(system_prompt) > 40 THEN concat(left(system_prompt, 40), '...') ELSE system_prompt END AS preview,
        array_to_string(list_reverse(string_split(system_prompt, '')), '') AS reversed, {strip('system_prompt')} AS stripped FROM system_prompts"""
    q["normalized_answers"] = f"SELECT example_id, {normalize(chr(99) + 'oalesce(answer, ' + chr(39) * 2 + ')')} AS normalized FROM split_examples"
    q["syllable_counts"] = """WITH w AS (SELECT example_id, w, len(regexp_extract_all(w, '[aeiouy]+')) AS g FROM (SELECT example_id, unnest(regexp_extract_all(lower(question), '[a-z]+')) AS w FROM split_examples)),
        c AS (SELECT example_id, sum(greatest(1, g - (ends_with(w, 'e') AND NOT ends_with(w, 'le') AND g > 1)::INT)) AS n FROM w GROUP BY 1)
        SELECT s.example_id, CASE WHEN question IS NOT NULL THEN coalesce(n, 0)::INT END AS syllables FROM split_examples s LEFT JOIN c USING (example_id)"""
    q["completion_split"] = f"""WITH w AS (SELECT item_id, {tokens('context')} AS w, (1 + item_id % 8) / 10.0::DOUBLE AS r FROM ift_data_pwc WHERE context IS NOT NULL),
        c AS (SELECT *, len(w) AS n, least(greatest(floor(len(w) * r)::INT, 1), len(w) - 1) AS cut FROM w)
        SELECT item_id, CASE WHEN n = 0 THEN 'text' WHEN n < 2 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:cut], ' ') END AS prompt,
        CASE WHEN n < 2 THEN 'Nothing to complete.' ELSE array_to_string(w[cut + 1:], ' ') END AS rest FROM c"""
    q["prefix_match_ratio"] = f"""WITH w AS (SELECT example_id, {tokens('answer')} AS r, {tokens('answer_8b')} AS h FROM split_examples WHERE answer IS NOT NULL AND answer_8b IS NOT NULL),
        d AS (SELECT *, list_filter(range(1, len(r) + 1), lambda i: r[i] IS DISTINCT FROM h[i])[1] AS first FROM w)
        SELECT example_id, round(CASE WHEN len(r) = 0 THEN 1.0 ELSE (coalesce(first, len(r) + 1) - 1)::DOUBLE / len(r) END, 6) AS ratio FROM d"""
    q["prompt_template"] = "SELECT id, generation_batch, concat('Write 12 questions for a ', coalesce(complexity, ''), ' prompt on ', coalesce(domain, ''), '.') AS prompt FROM system_prompts"
    q["category_blocks"] = "SELECT id, generation_batch, array_to_string(list_filter([CASE WHEN contains(category, 'constraint') THEN 'Test the limits.' END, CASE WHEN category = 'persona' THEN 'Address the persona.' END, CASE WHEN complexity = 'complex' THEN 'Combine rules.' END], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS instructions FROM system_prompts"

    se = f1_table("split_examples", "example_id, category, question", "answer", "answer_8b")
    q["qa_em_f1_by_category"] = f"SELECT coalesce(category, '') AS category, count(*) AS n, round(100 * avg((array_to_string(g, ' ') = array_to_string(p, ' '))::INT), 6) AS em, round(100 * avg({TOKEN_F1}), 6) AS f1 FROM {se} GROUP BY 1"
    closed = lambda x: f"(len({x}) = 1 AND {x}[1] IN ('yes', 'no', 'noanswer'))"
    q["qa_f1_strict"] = f"SELECT example_id, round(CASE WHEN ({closed('g')} OR {closed('p')}) AND g != p THEN 0.0 ELSE {harmonic('common', 'g', 'p')} END, 6) AS f1 FROM {se}"
    sq = f1_table("split_examples", "example_id", "question", "answer_8b")
    q["qa_max_over_golds"] = f"WITH a AS (SELECT example_id, {TOKEN_F1} AS f FROM {se}), b AS (SELECT example_id, CASE WHEN question IS NULL THEN 0 ELSE f END AS f FROM (SELECT example_id, {TOKEN_F1} AS f FROM {sq}) JOIN split_examples USING (example_id)) SELECT example_id, round(greatest(a.f, b.f), 6) AS f1 FROM a JOIN b USING (example_id)"
    q["fact_scores"] = f"""WITH w AS (SELECT example_id, list_distinct({tokens('answer_8b')}) AS p, list_distinct({tokens('answer')}) AS g FROM split_examples WHERE answer IS NOT NULL AND answer_8b IS NOT NULL),
        c AS (SELECT *, len(list_intersect(p, g)) AS tp FROM w)
        SELECT example_id, round(CASE WHEN len(p) > 0 THEN tp::DOUBLE / len(p) ELSE 0.0 END, 6) AS precision, round(CASE WHEN len(g) > 0 THEN tp::DOUBLE / len(g) ELSE 0.0 END, 6) AS recall,
        round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (len(p) + len(g)) ELSE 0.0 END, 6) AS f1, (tp = len(p) AND tp = len(g))::INT::DOUBLE AS em FROM c"""
    tri = lambda x: f"CASE WHEN length({x}) = 0 THEN [] WHEN length({x}) < 3 THEN [{x}] ELSE list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3))) END"
    q["trigram_jaccard_pairs"] = f"""WITH w AS (SELECT example_id, {tri('answer')} AS x, {tri('answer_8b')} AS y FROM split_examples WHERE answer IS NOT NULL AND answer_8b IS NOT NULL), c AS (SELECT *, len(list_intersect(x, y)) AS b FROM w)
        SELECT example_id, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 ELSE b::DOUBLE / (len(x) + len(y) - b) END, 6) AS jaccard FROM c"""
    q["difficulty_weights"] = "SELECT example_id, CAST((0.5::DOUBLE + 1.5::DOUBLE * (0.6::DOUBLE * coalesce(filter_metrics.norm_edit_distance, 0.5) + 0.4::DOUBLE * (1 - coalesce(filter_metrics.jaccard_similarity, 0.5))))::VARCHAR AS DECIMAL(12, 4))::DOUBLE AS weight, round(length(answer)::DOUBLE / greatest(length(coalesce(answer_8b, '')), 1), 6) AS length_ratio FROM split_examples"
    for v in ("responses", "qa", "turns", "plain", "tools"):
        q[f"think_split_{v}"] = think(v)
    q["tool_calls"] = f"SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _call('text').items())} FROM documents WHERE kind = 'tool'"
    q["tool_call_scores"] = _scores()
    q["tool_call_rates"] = f"SELECT count(*) AS n, avg(thought::INT) AS thought, avg(action::INT) AS action, avg(args::INT) AS args, avg(\"full\"::INT) AS \"full\" FROM ({_scores()})"
    # what is known of the made-up instructions: a text without the marks of its own keeps its parts
    q["dialogue_turns"] = f"""WITH l AS (SELECT doc_id, i, string_split(x, chr(10))[i] AS line FROM (SELECT doc_id, {strip('text')} AS x, unnest(range(1, len(string_split({strip('text')}, chr(10))) + 1)) AS i FROM documents WHERE kind = 'dialogue')),
        o AS (SELECT *, sum((starts_with(line, 'Human: ') OR starts_with(line, 'AI: '))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l)
        SELECT doc_id, (k - 1)::INT AS turn, CASE WHEN starts_with(first(line ORDER BY i), 'Human: ') THEN 'user' ELSE 'assistant' END AS role,
        {strip("string_agg(CASE WHEN starts_with(line, 'Human: ') THEN substr(line, 8) WHEN starts_with(line, 'AI: ') THEN substr(line, 5) ELSE line END, chr(10) ORDER BY i)")} AS content FROM o WHERE k > 0 GROUP BY doc_id, k"""

    ck = _checks()
    sel = ", ".join(f"({v}) AS {k}" for k, v in ck.items())
    src = "(SELECT *, coalesce(answer, '') AS a FROM split_examples)"
    q["rule_checks"] = f"SELECT example_id, {sel} FROM {src}"
    q["rule_checks_more"] = f"SELECT doc_id, {', '.join(f'coalesce({v}, false) AS {k}' for k, v in _more_checks().items())} FROM (SELECT doc_id, coalesce(text, '') AS a FROM documents)"
    passed = " + ".join(f"({v})::INT" for v in ck.values())
    n = len(ck)
    q["rule_checks_summary"] = f"""WITH c AS (SELECT coalesce(split, '') AS method, {passed} AS p FROM {src})
        SELECT method, count(*) AS total_entries, count_if(p = {n}) AS fully_passed, count(*) * {n} AS total_checks, sum(p)::BIGINT AS passed_checks, round(count_if(p = {n}) / count(*), 6) AS entry_pass_rate, round(sum(p)::DOUBLE / (count(*) * {n}), 6) AS check_pass_rate FROM c GROUP BY 1"""
    first = list(ck.items())[:6]
    q["rule_checks_in_rows"] = " UNION ALL ".join([f"SELECT '{k}' AS name, count(*) AS n, count_if({v}) AS passed FROM {src}" for k, v in first] + [f"SELECT 'no_such_check' AS name, count(*) AS n, 0 AS passed FROM {src}"])
    q["json_checks"] = "SELECT event_id, coalesce(json_valid(props), false) AS valid_json, coalesce(CASE WHEN json_valid(props) THEN json_keys(props) = ['k'] END, false) AS has_exact_keys FROM events"
    q["json_responses"] = "SELECT event_id, CASE WHEN json_valid(props) THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events"

    q["conversation_render"] = "SELECT item_id, array_to_string(list_transform(conversations, lambda m: concat('<|im_start|>', m.role, chr(10), coalesce(m.content, ''), '<|im_end|>', chr(10))), '') AS rendered FROM ift_data_pwc WHERE conversations IS NOT NULL"
    q["conversation_pairs"] = f"SELECT * FROM {PAIRS}"
    q["complete_conversations"] = "SELECT item_id, dataset FROM ift_data_pwc WHERE len(conversations) = 4"
    q["assistant_mask_spans"] = f"SELECT item_id, pos, role, role = 'assistant' AS learn, length(content) AS chars FROM {MESSAGES}"
    q["prefix_label_arrays"] = "SELECT example_id, 128 AS n, least(128, length(question) + length(answer)) AS used, least(128, length(question)) + (128 - least(128, length(question) + length(answer))) AS ignored FROM split_examples WHERE answer IS NOT NULL AND question IS NOT NULL UNION ALL SELECT example_id, NULL, NULL, NULL FROM split_examples WHERE answer IS NOT NULL AND question IS NULL"
    q["turn_replay"] = f"SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY pos) - 1 AS turn, pos AS messages, content AS answer FROM {MESSAGES} WHERE role = 'assistant'"
    m = lambda role, x: f"concat('<|im_start|>{role}', chr(10), coalesce({x}, ''), '<|im_end|>', chr(10))"
    gen = "'<|im_start|>assistant' || chr(10)"
    ref = "CASE WHEN context IS NULL OR question IS NULL THEN NULL ELSE concat(context, chr(10), chr(10), question) END"
    q["prompt_modes"] = f"""SELECT example_id, 'train' AS mode, md5(concat({m('user', 'question')}, {m('assistant', 'answer')})) AS digest FROM split_examples
        UNION ALL SELECT example_id, 'reference', md5(concat({m('user', ref)}, {gen})) FROM split_examples UNION ALL SELECT example_id, x, md5(concat({m('user', 'question')}, {gen})) FROM split_examples, (SELECT unnest(['question', 'bare']) AS x)"""
    title = " OR ".join(f"regexp_matches(line, '^{WS}*={{{k}}}[^=].*={{{k}}}{WS}*$')" for k in range(1, 7))
    q["article_sessions"] = f"""WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE kind = 'article')),
        m AS (SELECT *, ({title}) AS is_title FROM l), o AS (SELECT *, sum(is_title::INT) OVER (PARTITION BY doc_id ORDER BY i) AS article FROM m),
        g AS (SELECT doc_id, article::BIGINT AS article, {strip("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT is_title), '')")} AS t FROM o WHERE article > 0 GROUP BY doc_id, article)
        SELECT doc_id, article, length(t) AS chars FROM g WHERE t != '' AND len(regexp_extract_all(t, '[A-Za-z]{{2,}}')) >= 5 AND length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g')) * 1000 <= length(t)"""
    pf = f1_table(PAIRS, "item_id, pos", "question", "answer")
    q["turn_scores"] = f"""WITH f AS (SELECT item_id, pos, round({TOKEN_F1}, 6) AS f, count(*) OVER (PARTITION BY item_id) AS n FROM {pf})
        SELECT pos::INT AS pos, round(sum(f), 4) AS score_sum, count(*) AS counted, round(sum(f) / (SELECT count(DISTINCT item_id) FROM f), 6) AS mean FROM f WHERE n = 2 GROUP BY pos"""
    q["conversation_scores"] = f"SELECT item_id, round(avg({words('answer')}), 6) AS mean, count_if({strip(chr(99) + 'oalesce(answer, ' + chr(39) * 2 + ')')} = '') AS errors FROM {PAIRS} GROUP BY 1"

    q["context_groups"] = "SELECT md5(text) AS digest, min(doc_id) AS first_pos, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text"
    q["grouped_questions"] = f"""SELECT min(example_id) AS first_pos, count(*) AS turns, md5(coalesce(string_agg(question, '|' ORDER BY example_id), '')) AS digest FROM split_examples
        WHERE context IS NOT NULL AND coalesce(answer != 'No', true) GROUP BY {strip('context')}"""
    pw = f"(SELECT p.*, {words('question')} + {words('answer')} AS words FROM {PAIRS} p)"
    run = f"(SELECT *, sum(words) OVER (PARTITION BY item_id ORDER BY pos) AS s FROM {pw})"
    q["prefix_trim_words"] = f"SELECT i.item_id, count(s.pos)::INT AS turns FROM ift_data_pwc i LEFT JOIN (SELECT * FROM {run} WHERE s <= 60) s USING (item_id) WHERE {GOOD} GROUP BY 1"
    q["prefix_trim_rows"] = f"SELECT item_id, pos, words FROM {run} WHERE s <= 60"
    q["drop_over_budget"] = f"""WITH w AS (SELECT item_id, sum(words) AS total, count_if({words('question')} <= 40 AND {words('answer')} <= 40) AS turns FROM {pw} GROUP BY 1)
        SELECT i.item_id, coalesce(turns, 0)::INT AS turns FROM ift_data_pwc i LEFT JOIN w USING (item_id) WHERE {GOOD} AND {words('context')} <= 300 AND coalesce(total, 0) <= 100"""
    q["length_gate"] = "SELECT item_id, contextlen, conversationlen FROM ift_data_pwc WHERE contextlen <= 400 AND conversationlen <= 200"
    q["zipped_turns"] = f"SELECT i.item_id, (2 * count(p.pos))::INT AS messages FROM ift_data_pwc i LEFT JOIN {PAIRS} p USING (item_id) WHERE {GOOD} GROUP BY 1"
    q["lettered_choice"] = f"SELECT md5({strip('system_prompt')}) AS digest, id AS question, [category, complexity, domain, id][generation_batch % 5 + 1] AS answer FROM system_prompts"
    q["selected_passages"] = "SELECT array_to_string(list(coalesce(kind, '') ORDER BY doc_id), chr(10) || chr(10)) AS context, source AS question, min(doc_id)::VARCHAR AS answer FROM documents GROUP BY source HAVING count_if(kind = 'chat') > 0"
    q["joined_contexts"] = f"""WITH p AS (SELECT id, system_prompt AS c, row_number() OVER (ORDER BY {seeded('id', 7)}) - 1 AS place, count(*) OVER () AS n FROM {last('system_prompts', 'id', 'generation_batch')})
        SELECT a.id, (sum(length(b.c)) + 2 * (count(*) - 1))::INT AS chars FROM p a JOIN p b ON (b.place - a.place + a.n) % a.n < least(3, a.n) GROUP BY a.id"""
    tk = lambda x: f"(({words(x)} * 13 + 9) // 10)"
    q["corpus_records"] = f"""WITH p AS (SELECT item_id, sum({tk('question')} + {tk('answer')}) + 11 * count(*) AS n FROM {PAIRS} GROUP BY 1)
        SELECT 'pwc' AS dataset, count(*) AS n, sum({tk('context')})::BIGINT AS contextlen, sum(coalesce(p.n, 0))::BIGINT AS conversationlen FROM ift_data_pwc i LEFT JOIN p USING (item_id) WHERE {GOOD}"""
    q["valid_articles"] = f"SELECT doc_id, coalesce({strip('text')} != '' AND len(regexp_extract_all(text, '[A-Za-z]{{2,}}')) >= 5 AND length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) * 1000 <= length(text), false) AS valid FROM documents"

    r32, r8 = last("responses_32b", "question_id", "loaded_at"), last("responses_8b", "question_id", "loaded_at")
    q["inner_pairs"] = f"SELECT a.question_id, a.system_prompt_id FROM {r32} a JOIN {r8} b ON a.question_id = b.question_id"
    q["one_sided_counts"] = "WITH a AS (SELECT DISTINCT question_id FROM responses_32b WHERE question_id IS NOT NULL), b AS (SELECT DISTINCT question_id FROM responses_8b WHERE question_id IS NOT NULL) SELECT count_if(a.question_id IS NOT NULL AND b.question_id IS NOT NULL) AS \"both\", count_if(b.question_id IS NULL) AS only_a, count_if(a.question_id IS NULL) AS only_b FROM a FULL JOIN b ON a.question_id = b.question_id"
    q["resume_antijoin"] = f"SELECT DISTINCT question_id FROM {QUESTIONS} WHERE NOT EXISTS (SELECT 1 FROM responses_32b r WHERE r.question_id = questions.question_id) OR NOT EXISTS (SELECT 1 FROM responses_8b r WHERE r.question_id = questions.question_id)".replace(f"FROM {QUESTIONS} WHERE", f"FROM {QUESTIONS} AS questions WHERE")
    q["question_defaults"] = f"SELECT question_type, question_difficulty, count(*) AS n, sum(tags)::BIGINT AS tags FROM {QUESTIONS} GROUP BY 1, 2"
    q["off_topic_questions"] = f"SELECT DISTINCT question_id FROM {QUESTIONS} WHERE {OFF}"
    qrow = f"(SELECT DISTINCT ON (question_id) * FROM {QUESTIONS} WHERE question_id IS NOT NULL ORDER BY question_id, question DESC)"
    sp = last("system_prompts", "id", "generation_batch")
    q["joined_examples"] = f"SELECT q.question_id, q.system_prompt_id, coalesce(s.category, '') AS category, q.question_type, md5(s.system_prompt) AS context FROM {qrow} q JOIN {sp} s ON q.system_prompt_id = s.id JOIN {r32} r ON r.question_id = q.question_id WHERE EXISTS (SELECT 1 FROM responses_8b k WHERE k.question_id = q.question_id)"
    q["missing_examples"] = f"WITH k AS (SELECT DISTINCT question_id, EXISTS (SELECT 1 FROM responses_32b r WHERE r.question_id = q.question_id) AND EXISTS (SELECT 1 FROM system_prompts s WHERE s.id = q.system_prompt_id) AS hit FROM {qrow} q) SELECT count(*) AS kept, count_if(hit) AS joined, count_if(NOT hit) AS missing FROM k"
    q["last_duplicate_wins"] = "SELECT id, max(generation_batch) AS generation_batch FROM system_prompts GROUP BY id"
    q["group_split"] = f"""WITH g AS (SELECT DISTINCT system_prompt_id AS id FROM split_examples WHERE system_prompt_id IS NOT NULL), c AS (SELECT greatest(1, round_even(count(*) * 0.1::DOUBLE, 0))::BIGINT AS k FROM g),
        r AS (SELECT id, row_number() OVER (ORDER BY {seeded('id', 42)}, id) AS rank FROM g), s AS (SELECT id, CASE WHEN rank <= k THEN 'test' WHEN rank <= 2 * k THEN 'eval' ELSE 'train' END AS split FROM r, c)
        SELECT coalesce(s.split, 'train') AS split, count(*) AS rows, count(DISTINCT e.system_prompt_id) AS groups FROM split_examples e LEFT JOIN s ON e.system_prompt_id = s.id GROUP BY 1"""
    q["row_split"] = f"SELECT doc_id FROM documents WHERE ('0x' || substr({seeded('doc_id', 42)}, 1, 13))::BIGINT / {float(16**13)!r}::DOUBLE < 0.1::DOUBLE"
    q["seeded_sample_1000"] = f"SELECT doc_id, source FROM documents ORDER BY {seeded('doc_id', 42)}, doc_id LIMIT 1000"
    mean = lambda c: f"coalesce(round(avg(CASE WHEN length({c}) > 0 THEN length({c}) END), 1), 0.0)"
    q["split_stats"] = "SELECT count(*) AS total, " + ", ".join(f"count_if(split = '{x}') AS {x}, count_if(split = '{x}' AND coalesce(question_type, '') = 'off_topic') AS {x}_off_topic" for x in ("train", "eval", "test")) + f", count(DISTINCT system_prompt_id) AS unique_sps, {mean('context')} AS avg_context_chars, {mean('answer')} AS avg_answer_chars FROM split_examples"
    q["train_without_off_topic"] = "SELECT split, count(*) AS n FROM split_examples WHERE NOT (split = 'train' AND coalesce(question_type, '') = 'off_topic') GROUP BY 1"
    q["value_counts"] = "SELECT coalesce(category, 'unknown') AS value, count(*) AS n FROM split_examples GROUP BY 1"
    q["two_key_counts"] = "SELECT category, complexity, count(*) AS n, count(DISTINCT domain) AS domains FROM system_prompts GROUP BY 1, 2"
    q["largest_deficit"] = "SELECT category, complexity, 1000 - count(*) AS deficit FROM system_prompts WHERE category IS NOT NULL AND complexity IS NOT NULL GROUP BY 1, 2 HAVING count(*) < 1000 ORDER BY deficit DESC, min(id) LIMIT 1"
    q["valid_prompts"] = f"SELECT id, generation_batch, coalesce(length({strip('system_prompt')}) >= 20 AND length({strip('domain')}) >= 2 AND (generation_batch % 2 = 0 OR category = 'persona') AND category IS NOT NULL AND complexity != 'simple', false) AS valid FROM system_prompts"
    q["valid_question_sets"] = f"SELECT coalesce(len(list_filter(questions, lambda q: q.on_topic)) = 10 AND len(list_filter(questions, lambda q: NOT q.on_topic)) = 2 AND len(questions) = 12 AND len(list_filter(questions, lambda q: length({strip('q.question')}) >= 5)) = 12, false) AS ok, count(*) AS n FROM questions GROUP BY 1"
    q["cost_estimate"] = "SELECT count(*) AS items, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, round((coalesce(sum(input_tokens), 0) * 0.2::DOUBLE + coalesce(sum(output_tokens), 0) * 0.6::DOUBLE) / 1000000, 6) AS cost FROM responses_32b"
    q["numbered_prompts"] = "SELECT id, printf('n_%05d', row_number() OVER (ORDER BY id) - 1) AS number FROM (SELECT DISTINCT id FROM system_prompts)"
    q["latest_domains"] = f"WITH p AS {last('(SELECT * FROM system_prompts WHERE domain IS NOT NULL)', 'id', 'generation_batch')}, l AS (SELECT * FROM p ORDER BY id DESC LIMIT 100) SELECT string_agg('- ' || domain, chr(10) ORDER BY id) AS avoid FROM l"
    q["widened_responses"] = "SELECT question_id, max(CASE WHEN l = 'big' THEN t END) AS big, max(CASE WHEN l = 'small' THEN t END) AS small FROM (SELECT question_id, 'big' AS l, output_tokens AS t FROM responses_32b UNION ALL SELECT question_id, 'small', output_tokens FROM responses_8b) GROUP BY 1"
    q["matched_results"] = "SELECT CASE WHEN item_id % 3 > 0 THEN item_id ELSE item_id + 10000 END AS id, item_id - 1 AS pos, item_id AS entry_id, suite FROM benchmark"

    cap = lambda x: f"CASE WHEN {x} = '' OR {x}[1] != lower({x}[1]) THEN {x} ELSE concat(upper({x}[1]), {x}[2:]) END"
    sa, sb = strip("coalesce(answer, '')"), strip("coalesce(answer_8b, '')")
    q["span_questions"] = f"SELECT md5({strip('context')}) AS context, md5({strip('question')}) AS question, md5(concat({cap('a')}, '|', {cap('b')})) AS answers FROM (SELECT *, {sa} AS a, {sb} AS b FROM split_examples)"
    q["dialogue_arrays"] = f"SELECT turns, count(*) AS n, sum(2 * turns)::BIGINT AS messages FROM (SELECT i.item_id, count(p.pos)::INT AS turns FROM ift_data_pwc i LEFT JOIN {PAIRS} p USING (item_id) WHERE {GOOD} GROUP BY 1) GROUP BY 1"
    q["answer_variants"] = "SELECT example_id, 0 AS variant, length(answer) AS chars FROM split_examples UNION ALL SELECT example_id, 1, length(answer_8b) FROM split_examples"
    q["distill_rows"] = "SELECT coalesce(difficulty_weight, 1.0) = 1.0 AS is_default, count(*) AS n, round(sum(coalesce(difficulty_weight, 1.0)), 3) AS weight FROM split_examples GROUP BY 1"
    q["adversarial_rows"] = "SELECT printf('adv_%03d', item_id) AS question_id, printf('sp_ADV%02d', item_id) AS system_prompt_id, 'adversarial' AS category, 'on_topic' AS question_type, 3.0::DOUBLE AS difficulty_weight, suite AS question FROM benchmark"
    q["method_texts"] = "SELECT example_id, 'teacher' AS method, md5(coalesce(answer, '')) AS text FROM split_examples UNION ALL SELECT example_id, 'small', md5(answer_8b) FROM split_examples WHERE answer_8b IS NOT NULL UNION ALL SELECT example_id, 'echo', md5(question) FROM split_examples WHERE question IS NOT NULL"
    q["work_items"] = f"SELECT DISTINCT q.question_id, q.system_prompt_id, md5(s.system_prompt) AS system_prompt FROM {QUESTIONS} q JOIN {sp} s ON q.system_prompt_id = s.id"
    q["group_members"] = "SELECT doc_id, count(*) OVER (PARTITION BY text) AS n, min(doc_id) OVER (PARTITION BY text) AS first FROM documents"
    q["id_set_operations"] = "WITH a AS (SELECT question_id AS k FROM responses_32b WHERE question_id IS NOT NULL), b AS (SELECT question_id AS k FROM responses_8b WHERE question_id IS NOT NULL) SELECT 'both' AS part, count(*) AS n, min(k) AS first FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'only_a', count(*), min(k) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'only_b', count(*), min(k) FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT 'all', count(*), min(k) FROM (SELECT k FROM a UNION ALL SELECT k FROM b)"
    q["finite_values"] = "SELECT event_id, CASE WHEN event_id % 7 != 0 AND event_id % 11 != 0 THEN round(value, 4) END AS value FROM events"
    q["positions"] = "SELECT * FROM (SELECT item_id, suite FROM benchmark WHERE item_id >= 10 ORDER BY item_id LIMIT 5) UNION ALL SELECT item_id, suite FROM benchmark WHERE item_id IN (3, 299)"

    q["random_context_groups"] = f"""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY {seeded('doc_id', 3)}) AS place FROM documents), g AS (SELECT greatest(1, ceil(sum({words(t)}) / 2000.0::DOUBLE))::BIGINT AS g, count(*) AS n FROM documents)
        SELECT doc_id, CASE WHEN n // g = 0 THEN place - 1 WHEN place - 1 < (n % g) * (n // g + 1) THEN (place - 1) // (n // g + 1) ELSE n % g + (place - 1 - (n % g) * (n // g + 1)) // (n // g) END AS group_id FROM d, g"""
    q["length_buckets"] = f"SELECT ceil({words(t)} / 100.0::DOUBLE)::INT AS bucket, count(*) AS n FROM documents GROUP BY 1"
    h = f"('0x' || substr({seeded('question_id', 5)}, 1, 8))::BIGINT"
    q["gold_picks"] = f"SELECT DISTINCT question_id, ['a', 'b', 'c'][{h} % 3 + 1] AS pick, CASE WHEN {h} / {float(16**8)!r}::DOUBLE < 0.3::DOUBLE THEN 'RECON' ELSE 'COMP' END AS task FROM {QUESTIONS} WHERE question_id IS NOT NULL"
    stats = lambda c: f"round(avg({c}), 6) AS {c}_mean, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS {c}_median, min({c}) AS {c}_min, max({c}) AS {c}_max"
    q["length_profile"] = f"SELECT dataset, grouping(dataset)::BOOLEAN AS total, count(*) AS n, {stats('contextlen')}, {stats('conversationlen')} FROM ift_data_pwc GROUP BY ROLLUP (dataset)"
    q["length_histogram"] = "SELECT CASE WHEN length(text) >= 4000 THEN 21 ELSE length(text) // 200 + 1 END AS bin, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1"
    pack = lambda v: f"count({v}) AS n, round(avg({v}), 6) AS mean, round(stddev_pop({v}), 6) AS std, round(quantile_cont({v}, 0.5), 6) AS median, round(quantile_cont({v}, 0.1), 6) AS p10, round(quantile_cont({v}, 0.9), 6) AS p90"
    q["value_stats"] = f"SELECT event_type, {pack('value')} FROM events GROUP BY 1"
    e = "exp(l_discount)"
    q["weighted_mean_ppl"] = f"SELECT l_returnflag, round(sum(l_discount * l_quantity) / greatest(sum(l_quantity), 1), 6) AS loss, round(exp(sum(l_discount * l_quantity) / greatest(sum(l_quantity), 1)), 6) AS ppl, count({e}) AS ppl_n, round(avg({e}), 6) AS ppl_mean, round(stddev_pop({e}), 6) AS ppl_std, round(quantile_cont({e}, 0.5), 6) AS ppl_median, round(quantile_cont({e}, 0.1), 6) AS ppl_p10, round(quantile_cont({e}, 0.9), 6) AS ppl_p90 FROM lineitem GROUP BY 1"
    w = "OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"
    q["rolling_stats"] = f"SELECT event_id, count(v) {w} AS n, (sum(v) {w})::BIGINT AS total, min(v) {w} AS least, max(v) {w} AS most, round(avg(v) {w}, 2) AS mean, round(stddev_samp(v) {w}, 1) AS std FROM (SELECT *, round(value * 10000)::BIGINT AS v FROM events)"
    norm = lambda v: f"sqrt(list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)))"
    q["vector_norms"] = f"SELECT vec_id, round({norm('embedding')}, 5) AS norm FROM embeddings"
    q["vector_stats"] = f"""WITH v AS (SELECT vec_id AS k, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 20),
        c AS (SELECT list_dot_product(a.v, b.v) / ({norm('a.v')} * {norm('b.v')}) AS c FROM v a JOIN v b ON a.k < b.k)
        SELECT (SELECT count(*) FROM v) AS n, round((SELECT avg({norm('v')}) FROM v), 5) AS norm_mean, round(avg(c), 5) AS cos_mean, round(stddev_samp(c), 5) AS cos_std, round(min(c), 5) AS cos_min, round(max(c), 5) AS cos_max FROM c"""
    q["event_windows"] = "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
    return q
