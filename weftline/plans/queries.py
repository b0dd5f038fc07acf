"""The library's queries over the test tables: name -> (spark, folder) -> DataFrame, on whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, scoring, text
from ..operators import chat, corpus, curate, grouping, profile, projections, relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- scalar functions ---


@query
def text_counts(s, d):
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", text.word_count(t).alias("words"), text.approx_tokens(t).alias("approx_tokens"), F.size(text.sentences(t)).alias("sentences"), F.size(text.lines(t)).alias("lines"), text.letter_count(t).alias("letters"))


@query
def text_rewrites(s, d):
    t = F.col("system_prompt")
    return table(s, d, "system_prompts").select("id", "generation_batch", text.rot13(t).alias("rot13"), text.capitalize_first(t).alias("capital"), text.file_name(t).alias("file_name"), text.preview(t, 40).alias("preview"), F.reverse(t).alias("reversed"), text.strip(t).alias("stripped"))


@query
def normalized_answers(s, d):
    return table(s, d, "split_examples").select("example_id", text.normalize_answer(F.coalesce("answer", F.lit(""))).alias("normalized"))


@query
def syllable_counts(s, d):
    words = F.regexp_extract_all(F.lower("question"), F.lit("[a-z]+"), F.lit(0))
    return table(s, d, "split_examples").select("example_id", F.aggregate(words, F.lit(0), lambda n, w: n + text.syllables(w)).alias("syllables"))


@query
def completion_split(s, d):
    ratio = (1 + F.pmod("item_id", F.lit(8))) / 10
    return table(s, d, "ift_data_pwc").where("context is not null").select("item_id", text.completion(F.col("context"), ratio).alias("c")).select("item_id", "c.prompt", "c.rest")


@query
def prefix_match_ratio(s, d):
    e = table(s, d, "split_examples").where("answer is not null and answer_8b is not null")
    return e.select("example_id", F.round(text.prefix_match(text.tokens(F.col("answer")), text.tokens(F.col("answer_8b"))), 6).alias("ratio"))


@query
def prompt_template(s, d):
    t = F.lit("Write {n} questions for a {complexity} prompt on {domain}.")
    p = table(s, d, "system_prompts")
    return p.select("id", "generation_batch", text.fill_template(t, {"n": F.lit(12), "complexity": F.col("complexity"), "domain": F.col("domain")}).alias("prompt"))


@query
def category_blocks(s, d):
    c = F.col("category")
    return table(s, d, "system_prompts").select("id", "generation_batch", text.blocks((c.contains("constraint"), "Test the limits."), (c == "persona", "Address the persona."), (F.col("complexity") == "complex", "Combine rules.")).alias("instructions"))


# --- scoring ---


@query
def qa_em_f1_by_category(s, d):
    e = table(s, d, "split_examples").select(F.coalesce("category", F.lit("")).alias("category"), scoring.exact_match(F.col("answer"), F.col("answer_8b")).alias("em"), scoring.token_f1(F.col("answer"), F.col("answer_8b")).alias("f1"))
    return e.groupBy("category").agg(F.count("*").alias("n"), F.round(100 * F.avg("em"), 6).alias("em"), F.round(100 * F.avg("f1"), 6).alias("f1"))


@query
def qa_f1_strict(s, d):
    return table(s, d, "split_examples").select("example_id", F.round(scoring.strict_f1(F.col("answer"), F.col("answer_8b")), 6).alias("f1"))


@query
def qa_max_over_golds(s, d):
    golds = F.array(F.coalesce("answer", F.lit("")), F.col("question"))
    return table(s, d, "split_examples").select("example_id", F.round(scoring.best_over(golds, F.col("answer_8b"), scoring.token_f1), 6).alias("f1"))


@query
def fact_scores(s, d):
    e = table(s, d, "split_examples").where("answer is not null and answer_8b is not null")
    f = scoring.fact_scores(text.tokens(F.col("answer_8b")), text.tokens(F.col("answer")))
    return e.select("example_id", f.alias("f")).select("example_id", *[F.round(f"f.{k}", 6).alias(k) for k in ("precision", "recall", "f1", "em")])


@query
def trigram_jaccard_pairs(s, d):
    e = table(s, d, "split_examples").where("answer is not null and answer_8b is not null")
    return e.select("example_id", F.round(scoring.trigram_jaccard(F.col("answer"), F.col("answer_8b")), 6).alias("jaccard"))


@query
def edit_distance_pairs(s, d):
    e = table(s, d, "split_examples").where("answer is not null and answer_8b is not null")
    return e.select("example_id", F.round(scoring.edit_distance(F.col("answer"), F.col("answer_8b")), 4).alias("edit_distance"))


@query
def difficulty_weights(s, d):
    m = F.col("filter_metrics")
    return table(s, d, "split_examples").select("example_id", scoring.difficulty_weight(m["norm_edit_distance"], m["jaccard_similarity"]).alias("weight"), F.round(text.length_ratio(F.col("answer"), F.coalesce("answer_8b", F.lit(""))), 6).alias("length_ratio"))


def _think(variant):
    def run(s, d):
        r = table(s, d, "responses_32b").select("question_id", "loaded_at", "raw_response", scoring.split_think(F.col("raw_response"), variant).alias("t"))
        return r.select("question_id", "loaded_at", "t.think", "t.answer").distinct()

    return run


for _v in ("responses", "qa", "turns", "plain", "tools"):
    QUERIES[f"think_split_{_v}"] = _think(_v)


def _tool_docs(s, d):
    return table(s, d, "documents").where("kind = 'tool'").select("doc_id", "text")


@query
def tool_calls(s, d):
    return _tool_docs(s, d).select("doc_id", scoring.parse_tool_call(F.col("text")).alias("c")).select("doc_id", "c.*")


@query
def tool_call_scores(s, d):
    # each trace against the one whose number is one higher
    t = _tool_docs(s, d)
    other = relations.numbered(t, ["doc_id"], "%d", "k").select("k", F.col("doc_id").alias("_d"), F.col("text").alias("said"))
    mine = relations.numbered(t, ["doc_id"], "%d", "k", 1)
    pair = mine.join(other, "k")
    return pair.select("doc_id", scoring.tool_scores(F.col("text"), F.col("said")).alias("c")).select("doc_id", "c.*")


@query
def tool_call_rates(s, d):
    return profile.rates(tool_call_scores(s, d), ["thought", "action", "args", "full"])


@query
def dialogue_turns(s, d):
    t = table(s, d, "documents").where("kind = 'dialogue'").select("doc_id", F.posexplode(scoring.dialogue_turns(F.col("text"))).alias("turn", "m"))
    return t.select("doc_id", "turn", "m.role", "m.content")


# --- checks ---

CHECK_SET: list[tuple[str, dict]] = [
    ("min_length", {}), ("min_sentences", {}), ("no_letter_z", {}), ("no_question_marks", {}), ("ends_with_exclamation", {}), ("contains_string", {"target": "the"}), ("no_technical_jargon", {}),
    ("references_physical_sensation", {}), ("exactly_three_lines", {}), ("even_number_of_lines", {}), ("no_prose_paragraphs", {}), ("no_plaintext_english", {}), ("all_uppercase", {}), ("contains_spanish_markers", {}),
]


@query
def rule_checks(s, d):
    e = table(s, d, "split_examples").select("example_id", F.coalesce("answer", F.lit("")).alias("a"))
    return e.select("example_id", *[checks.check_column(n, F.col("a"), p).alias(n) for n, p in CHECK_SET])


MORE_CHECKS: list[tuple[str, dict]] = [
    ("is_rot13_encoded", {}), ("mentions_colors_when_decoded", {}), ("decoded_mentions_photosynthesis", {}), ("contains_reversed_paris", {}), ("contains_reversed_animals", {}), ("no_normal_english_content_words", {}),
    ("at_least_five_animals", {}), ("individual_words_spelled_normally", {}), ("words_are_reversed", {}), ("no_letter_e", {}), ("no_word_I", {}), ("has_warn_or_error", {}), ("starts_with_index_entry", {}), ("ends_with_end_entry", {}),
    ("contains_all_fact_markers", {}), ("no_agreement_phrases", {}), ("disagrees_with_democracy", {}), ("defends_social_media", {}), ("matey_at_least_twice", {}), ("first_person_perspective", {}), ("no_english_words", {}),
    ("not_contains_string", {"forbidden": ["winch", "Ledger"]}), ("starts_with", {"prefix": "The "}), ("ends_with", {"suffix": "."}), ("min_lines", {}), ("exactly_n_lines", {"n": 3}), ("sentence_count_range", {}), ("line_count_range", {}),
    ("each_line_min_words", {}), ("exactly_5_sentences", {}), ("every_sentence_10_words", {}), ("every_sentence_contains_indeed", {}), ("no_extra_text", {}), ("acrostic_spells", {"target": "T"}), ("exactly_n_paragraphs_with_separator", {"n": 2, "separator": "\n\n"}),
    ("each_paragraph_n_sentences", {"n": 2, "separator": "\n\n"}), ("every_line_has_timestamp", {}), ("every_line_has_log_level", {}), ("has_classification_line", {}), ("valid_json", {}), ("min_pirate_terms", {"min_count": 1}), ("topically_relevant", {}),
    ("every_sentence_starts_5_letter_word", {}), ("sentences_start_alphabetically", {}), ("simple_vocabulary", {"vocabulary": ["the", "of", "and", "a", "in"], "share": 0.2}),
]


@query
def rule_checks_more(s, d):
    t = table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("a"))
    return t.select("doc_id", *[checks.check_column(n, F.col("a"), p).alias(n) for n, p in MORE_CHECKS])


@query
def rule_checks_summary(s, d):
    r = checks.run_checks(table(s, d, "split_examples").withColumn("method", F.coalesce("split", F.lit(""))), "answer", CHECK_SET)
    return checks.tally(r, "method").withColumn("entry_pass_rate", F.round("entry_pass_rate", 6)).withColumn("check_pass_rate", F.round("check_pass_rate", 6))


@query
def rule_checks_in_rows(s, d):
    e = table(s, d, "split_examples").select("example_id", "answer", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(json.dumps(p, sort_keys=True)).alias("params")) for n, p in [*CHECK_SET[:6], ("no_such_check", {})]])).alias("c"))
    r = checks.run_checks_in_rows(e.select("example_id", "answer", "c.*"), "example_id", "answer", "name", "params", CHECK_SET)
    return r.groupBy("name").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


@query
def json_checks(s, d):
    e = table(s, d, "events").select("event_id", F.col("props").alias("p"))
    return e.select("event_id", *[F.coalesce(checks.check_column(n, F.col("p"), a), F.lit(False)).alias(n) for n, a in (("valid_json", {}), ("has_exact_keys", {"keys": ["k"]}))])


@query
def json_responses(s, d):
    wrapped = F.concat(F.lit("Here you are:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    return table(s, d, "events").select("event_id", F.try_variant_get(text.json_response(wrapped), "$.k", "long").alias("k"))


# --- conversations ---


@query
def conversation_render(s, d):
    return table(s, d, "ift_data_pwc").where("conversations is not null").select("item_id", chat.render(F.col("conversations")).alias("rendered"))


@query
def conversation_pairs(s, d):
    p = table(s, d, "ift_data_pwc").select("item_id", F.posexplode(chat.pairs_of(F.col("conversations"))).alias("pos", "p"))
    return p.select("item_id", "pos", "p.question", "p.answer")


@query
def complete_conversations(s, d):
    return table(s, d, "ift_data_pwc").where(F.size("conversations") == 4).select("item_id", "dataset")


@query
def assistant_mask_spans(s, d):
    m = table(s, d, "ift_data_pwc").select("item_id", F.posexplode(chat.mask_spans(F.col("conversations"))).alias("pos", "m"))
    return m.select("item_id", "pos", "m.role", "m.learn", F.length("m.content").alias("chars"))


@query
def prefix_label_arrays(s, d):
    # code points stand for tokens
    ids = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))
    e = table(s, d, "split_examples").where("answer is not null").select("example_id", chat.prefix_labels(ids("question"), ids("answer"), 128).alias("l"))
    return e.select("example_id", F.size("l.ids").alias("n"), F.aggregate("l.mask", F.lit(0), lambda a, x: a + x).alias("used"), F.size(F.filter("l.labels", lambda x: x == chat.IGNORE)).alias("ignored"))


@query
def turn_replay(s, d):
    r = table(s, d, "ift_data_pwc").select("item_id", F.explode(chat.turn_replay(F.col("conversations"))).alias("t"))
    return r.select("item_id", "t.turn", F.size("t.prompt").alias("messages"), "t.answer")


@query
def prompt_modes(s, d):
    e = table(s, d, "split_examples")
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), chat.render(chat.prompt_messages(m, F.col("context"), F.col("question"), answer=F.coalesce("answer", F.lit(""))), m != "train").alias("text")) for m in ("train", "reference", "question", "bare")])
    return e.select("example_id", F.explode(modes).alias("x")).select("example_id", "x.mode", F.md5("x.text").alias("digest"))


@query
def article_sessions(s, d):
    t = table(s, d, "documents").where("kind = 'article'").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return chat.articles(t, "line", ["pos"], ["doc_id"]).select("doc_id", "article", F.length("text").alias("chars"))


@query
def turn_scores(s, d):
    p = conversation_pairs(s, d).withColumn("f1", F.round(scoring.token_f1(F.col("question"), F.col("answer")), 6))
    r = profile.per_turn(p, "item_id", "pos", "f1", 2)
    return r.select("pos", F.round("score_sum", 4).alias("score_sum"), "counted", F.round("mean", 6).alias("mean"))


@query
def conversation_scores(s, d):
    p = conversation_pairs(s, d).withColumn("n", text.word_count(F.col("answer")))
    return profile.per_conversation(p, "item_id", "n", text.is_blank(F.col("answer"))).select("item_id", F.round("mean", 6).alias("mean"), "errors")


# --- corpus recipes ---


def _pwc_pairs(s, d):
    return table(s, d, "ift_data_pwc").where("context is not null and conversations is not null").select("item_id", "dataset", "context", chat.pairs_of(F.col("conversations")).alias("pairs"))


@query
def context_groups(s, d):
    return relations.distinct_texts(table(s, d, "documents"), "text", "doc_id").select(F.md5("text").alias("digest"), "first_pos", "n")


@query
def grouped_questions(s, d):
    g = corpus.grouped_by_text(table(s, d, "split_examples"), "context", "question", "answer", "example_id", sentinel="No")
    return g.select("first_pos", F.size("pairs").alias("turns"), F.md5(F.concat_ws("|", F.transform("pairs", lambda p: p["question"]))).alias("digest"))


@query
def prefix_trim_words(s, d):
    return _pwc_pairs(s, d).select("item_id", F.size(corpus.trim_to_words(F.col("pairs"), 60)).alias("turns"))


@query
def prefix_trim_rows(s, d):
    p = conversation_pairs(s, d).withColumn("words", text.word_count(F.col("question")) + text.word_count(F.col("answer")))
    return corpus.trim_rows_to_words(p, ["item_id"], "pos", F.col("words"), 60).select("item_id", "pos", "words")


@query
def drop_over_budget(s, d):
    p = _pwc_pairs(s, d).where((text.word_count(F.col("context")) <= 300) & (corpus.words_of_pairs(F.col("pairs")) <= 100))
    return p.select("item_id", F.size(corpus.drop_long_turns(F.col("pairs"), 40)).alias("turns"))


@query
def length_gate(s, d):
    return corpus.length_gate(table(s, d, "ift_data_pwc"), 400, 200).select("item_id", "contextlen", "conversationlen")


@query
def zipped_turns(s, d):
    t = _pwc_pairs(s, d).select("item_id", "context", F.transform("pairs", lambda p: p["question"]).alias("qs"), F.transform("pairs", lambda p: p["answer"]).alias("ans"))
    z = corpus.zipped_turns(t.withColumn("context", F.col("item_id").cast("string")), "context", "qs", "ans", trim=True)
    return z.select(F.col("context").cast("long").alias("item_id"), F.size("conversations").alias("messages"))


@query
def lettered_choice(s, d):
    q = table(s, d, "system_prompts").select("system_prompt", "id", F.array("category", "complexity", "domain", "id").alias("options"), F.substring(F.lit("ABCDE"), F.pmod("generation_batch", F.lit(5)) + 1, F.lit(1)).alias("letter"), "generation_batch")
    return corpus.lettered_choice(q, "system_prompt", "id", "options", "letter").select(F.md5("context").alias("digest"), "question", "answer")


@query
def selected_passages(s, d):
    g = table(s, d, "documents").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "kind"))).alias("x"))
    q = g.select(F.col("source").alias("query"), F.struct(F.transform("x", lambda y: (y["kind"] == "chat").cast("int")).alias("is_selected"), F.transform("x", lambda y: F.coalesce(y["kind"], F.lit(""))).alias("passage_text")).alias("passages"), F.transform("x", lambda y: y["doc_id"].cast("string")).alias("answers"))
    return corpus.selected_passages(q)


@query
def joined_contexts(s, d):
    p = relations.last_wins(table(s, d, "system_prompts").select("id", "generation_batch", "system_prompt"), ["id"], F.col("generation_batch"))
    return corpus.with_other_contexts(p, "system_prompt", 3, "id", seed=7).select("id", F.length("system_prompt").alias("chars"))


@query
def corpus_records(s, d):
    c = _pwc_pairs(s, d).select("item_id", "context", chat.conversation(F.col("pairs")).alias("conversations"))
    f = corpus.finish(c, text.approx_tokens, "pwc")
    return f.groupBy("dataset").agg(F.count("*").alias("n"), F.sum("contextlen").alias("contextlen"), F.sum("conversationlen").alias("conversationlen"))


@query
def valid_articles(s, d):
    return table(s, d, "documents").select("doc_id", text.valid_article(F.col("text")).alias("valid"))


# --- curation ---


@query
def inner_pairs(s, d):
    p = curate.response_pairs(table(s, d, "responses_32b"), table(s, d, "responses_8b"))
    return p.select("question_id", "system_prompt_id")


@query
def one_sided_counts(s, d):
    return relations.one_sided(table(s, d, "responses_32b"), table(s, d, "responses_8b"), "question_id")


@query
def resume_antijoin(s, d):
    work = curate.exploded_questions(table(s, d, "questions")).select("question_id").distinct()
    return relations.pending(work, [table(s, d, "responses_32b"), table(s, d, "responses_8b")], "question_id")


@query
def question_defaults(s, d):
    return curate.exploded_questions(table(s, d, "questions")).groupBy("question_type", "question_difficulty").agg(F.count("*").alias("n"), F.sum(F.size("tags")).alias("tags"))


@query
def off_topic_questions(s, d):
    q = curate.exploded_questions(table(s, d, "questions"))
    return q.where(curate.is_off_topic(F.col("question_id"), F.col("question_type"))).select("question_id").distinct()


@query
def similarity_filter(s, d):
    p = curate.response_pairs(table(s, d, "responses_32b"), table(s, d, "responses_8b"))
    return curate.similarity_filter(p, curate.exploded_questions(table(s, d, "questions")).select("question_id", "question_type"))


@query
def similarity_filter_stats(s, d):
    return curate.filter_stats(similarity_filter(s, d))


@query
def joined_examples(s, d):
    kept = table(s, d, "responses_8b").select("question_id").distinct()
    e = curate.join_examples(kept, table(s, d, "questions"), table(s, d, "system_prompts"), table(s, d, "responses_32b"), table(s, d, "responses_8b"))
    return e.select("question_id", "system_prompt_id", "category", "question_type", F.md5("context").alias("context"))


@query
def missing_examples(s, d):
    kept = curate.exploded_questions(table(s, d, "questions")).select("question_id").where("question_id is not null")
    e = curate.join_examples(kept, table(s, d, "questions"), table(s, d, "system_prompts"), table(s, d, "responses_32b"), table(s, d, "responses_8b"))
    return curate.missing_counts(kept, e)


@query
def last_duplicate_wins(s, d):
    return relations.last_wins(table(s, d, "system_prompts").select("id", "generation_batch", "complexity"), ["id"], F.col("generation_batch")).select("id", "generation_batch")


@query
def group_split(s, d):
    e = table(s, d, "split_examples").select("example_id", "system_prompt_id")
    return relations.group_split(e, "system_prompt_id", 0.1, 0.1, 42).groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("system_prompt_id").alias("groups"))


@query
def row_split(s, d):
    return relations.row_split(table(s, d, "documents").select("doc_id"), "doc_id", 0.1).where("held").select("doc_id")


@query
def seeded_sample_1000(s, d):
    return relations.seeded_sample(table(s, d, "documents").select("doc_id", "source"), "doc_id", 1000)


@query
def split_stats(s, d):
    return curate.split_stats(table(s, d, "split_examples"))


@query
def train_without_off_topic(s, d):
    return curate.train_without_off_topic(table(s, d, "split_examples")).groupBy("split").agg(F.count("*").alias("n"))


@query
def value_counts(s, d):
    return curate.value_counts(table(s, d, "split_examples"), "category")


@query
def two_key_counts(s, d):
    return table(s, d, "system_prompts").groupBy("category", "complexity").agg(F.count("*").alias("n"), F.count_distinct("domain").alias("domains"))


@query
def largest_deficit(s, d):
    have = table(s, d, "system_prompts")
    want = have.groupBy("category", "complexity").agg(F.min("id").alias("pos")).withColumn("target", F.lit(1000))
    return curate.largest_deficit(have, want, ["category", "complexity"], "pos")


@query
def valid_prompts(s, d):
    # a batch was asked for its own category or for personas, in whatever writing
    asked = F.when(F.pmod("generation_batch", F.lit(2)) == 0, F.concat(F.lit(" "), F.upper("category"))).otherwise("Persona\t")
    ok = curate.valid_prompt(F.col("system_prompt"), F.col("domain"), F.col("category"), F.col("complexity"), asked, F.when(F.col("complexity") != "simple", F.col("complexity")).otherwise(" Complex "))
    return table(s, d, "system_prompts").select("id", "generation_batch", ok.alias("valid"))


@query
def valid_question_sets(s, d):
    q = table(s, d, "questions").withColumn("ok", curate.valid_questions(F.col("questions"), 10, 2))
    return q.groupBy("ok").agg(F.count("*").alias("n"))


@query
def cost_estimate(s, d):
    return curate.cost_estimate(table(s, d, "responses_32b"))


@query
def numbered_prompts(s, d):
    return relations.numbered(relations.last_wins(table(s, d, "system_prompts").select("id", "generation_batch"), ["id"], F.col("generation_batch")), ["id"], "n_%05d").select("id", "number")


@query
def latest_domains(s, d):
    p = relations.last_wins(table(s, d, "system_prompts").where("domain is not null").select("id", "domain", "generation_batch"), ["id"], F.col("generation_batch"))
    return relations.latest(p, "id", 100).agg(text.bullet_list(F.transform(F.array_sort(F.collect_list(F.struct("id", "domain"))), lambda x: x["domain"])).alias("avoid"))


@query
def widened_responses(s, d):
    both = table(s, d, "responses_32b").select("question_id", F.lit("big").alias("label"), "output_tokens").union(table(s, d, "responses_8b").select("question_id", F.lit("small"), "output_tokens"))
    return relations.widen(both.groupBy("question_id", "label").agg(F.max("output_tokens").alias("t")), "question_id", "label", ["big", "small"], F.col("t"))


@query
def matched_results(s, d):
    entries = table(s, d, "benchmark").select(F.col("item_id").alias("id"), "suite", (F.col("item_id") - 1).alias("pos"))
    results = table(s, d, "benchmark").select(F.when(F.pmod("item_id", F.lit(3)) > 0, F.col("item_id")).otherwise(F.col("item_id") + 10_000).alias("id"), (F.col("item_id") - 1).alias("pos"))
    m = relations.match_or_position(results, entries, "id", "pos")
    return m.select("id", "pos", F.col("entry.id").alias("entry_id"), F.col("entry.suite").alias("suite"))


# --- projections ---


@query
def span_questions(s, d):
    p = projections.span_question(table(s, d, "split_examples").withColumn("answers", F.array(F.coalesce("answer", F.lit("")), F.coalesce("answer_8b", F.lit("")))), "context", "question", "answers")
    return p.select(F.md5("context").alias("context"), F.md5("question").alias("question"), F.md5(F.concat_ws("|", "answers")).alias("answers"))


@query
def dialogue_arrays(s, d):
    p = projections.dialogue_projection(_pwc_pairs(s, d), "context", "pairs")
    return p.groupBy(F.size("questions").alias("turns")).agg(F.count("*").alias("n"), F.sum(F.size("conversations")).alias("messages"))


@query
def answer_variants(s, d):
    v = projections.variants(table(s, d, "split_examples"), ["example_id"], ["answer", "answer_8b"])
    return v.select("example_id", "variant", F.length("conversation").alias("chars"))


@query
def distill_rows(s, d):
    r = projections.distill_rows(table(s, d, "split_examples"))
    return r.groupBy(F.col("difficulty_weight") == 1.0).agg(F.count("*").alias("n"), F.round(F.sum("difficulty_weight"), 3).alias("weight")).toDF("is_default", "n", "weight")


@query
def adversarial_rows(s, d):
    b = table(s, d, "benchmark").select((F.col("item_id") - 1).alias("pos"), F.col("text").alias("context"), F.col("suite").alias("question"))
    return projections.adversarial_rows(b, "pos").select("question_id", "system_prompt_id", "category", "question_type", "difficulty_weight", "question")


@query
def method_texts(s, d):
    e = table(s, d, "split_examples").select("example_id", F.to_json(F.struct(F.col("question_id").alias("id"), F.col("context").alias("system_prompt"), F.struct(F.struct("answer").alias("response")).alias("teacher"), F.struct(F.col("answer_8b").alias("answer")).alias("small"), F.col("question").alias("echo"), F.lit(7).alias("number"))).alias("raw"))
    return projections.method_texts(e, "example_id", "raw").select("example_id", "method", F.md5("text").alias("text"))


@query
def work_items(s, d):
    w = projections.work_items(curate.exploded_questions(table(s, d, "questions")), table(s, d, "system_prompts"))
    return w.select("question_id", "system_prompt_id", F.md5("system_prompt").alias("system_prompt")).distinct()


@query
def group_members(s, d):
    g = table(s, d, "documents").select("doc_id", F.xxhash64("text").alias("group_id"))
    return projections.group_members(g, "doc_id").select("doc_id", "n", "first")


@query
def id_set_operations(s, d):
    a, b = [table(s, d, t).select("question_id").where("question_id is not null") for t in ("responses_32b", "responses_8b")]
    parts = {"both": a.intersect(b), "only_a": a.subtract(b), "only_b": b.subtract(a), "all": a.union(b)}
    out = None
    for name, p in parts.items():
        row = p.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.min("question_id").alias("first"))
        out = row if out is None else out.unionByName(row)
    return out


@query
def finite_values(s, d):
    v = F.when(F.pmod("event_id", F.lit(7)) == 0, F.lit(float("nan"))).when(F.pmod("event_id", F.lit(11)) == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return table(s, d, "events").select("event_id", F.round(profile.finite(v), 4).alias("value"))


@query
def positions(s, d):
    b = table(s, d, "benchmark").select("item_id", "suite")
    return relations.from_position(b, "item_id", 10, 5).unionByName(relations.at_positions(b, "item_id", [3, 299, 9999]))


# --- packing and grouping ---


@query
def greedy_packing_sharded(s, d):
    b = grouping.greedy_pack(table(s, d, "documents"), "doc_id", text.approx_tokens(F.col("text")), 4096, shards=8)
    return b.groupBy("shard", "bin").agg(F.count("*").alias("items"), F.sum("cost").alias("cost"))


@query
def random_context_groups(s, d):
    g = grouping.random_groups(table(s, d, "documents"), "doc_id", text.word_count(F.col("text")), 2000, 3)
    return g


@query
def length_buckets(s, d):
    return table(s, d, "documents").groupBy(grouping.length_bucket(text.word_count(F.col("text"))).alias("bucket")).agg(F.count("*").alias("n"))


@query
def gold_picks(s, d):
    q = curate.exploded_questions(table(s, d, "questions")).where("question_id is not null").select("question_id", grouping.pick_by_hash(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("question_id"), 5).alias("pick"), grouping.task_choice(F.col("question_id"), 0.3, 5).alias("task"))
    return q.distinct()


# --- profiles ---


@query
def length_profile(s, d):
    return profile.profile(table(s, d, "ift_data_pwc"), "dataset", ["contextlen", "conversationlen"])


@query
def length_histogram(s, d):
    return profile.histogram(table(s, d, "documents"), F.length("text"), 0, 4000, 20)


@query
def value_stats(s, d):
    return profile.stat_table(table(s, d, "events"), ["event_type"], F.col("value"))


@query
def weighted_mean_ppl(s, d):
    loss, ppl = profile.weighted_loss(F.col("l_discount"), F.col("l_quantity"))
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(loss, 6).alias("loss"), F.round(ppl, 6).alias("ppl"), *[c.alias(f"ppl_{n}") for c, n in zip(profile.sample_ppl(F.col("l_discount"), 6), ("n", "mean", "std", "median", "p10", "p90"))])


@query
def rolling_stats(s, d):
    # values as whole ten-thousandths, so that sums are exact in any order
    e = table(s, d, "events").select("event_id", "event_type", F.round(F.col("value") * 10_000).cast("long").alias("value"))
    r = profile.rolling(e, ["event_type"], ["event_id"], "value", 50)
    return r.select("event_id", F.col("roll_n").alias("n"), F.col("roll_sum").cast("long").alias("total"), F.col("roll_min").alias("least"), F.col("roll_max").alias("most"), F.round("roll_mean", 2).alias("mean"), F.round("roll_std", 1).alias("std"))


@query
def vector_norms(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(profile.l2_norm(F.col("embedding")), 5).alias("norm"))


@query
def vector_stats(s, d):
    v = profile.vector_stats(table(s, d, "embeddings"), "vec_id", "embedding")
    return v.select("n", *[F.round(c, 5).alias(c) for c in ("norm_mean", "cos_mean", "cos_std", "cos_min", "cos_max")])


@query
def event_windows(s, d):
    from ..streaming.resume import late_events

    return late_events(table(s, d, "events"))


from . import more_queries, recipe_queries  # noqa: E402

QUERIES.update(recipe_queries.QUERIES | more_queries.QUERIES)
