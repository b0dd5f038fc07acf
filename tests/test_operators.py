import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import scoring
from weftline.operators import chat, corpus, curate, grouping, profile, recipes, relations
from weftline.sources import jsonl
from weftline.streaming.resume import append_stream

MSG = "array<struct<role:string,content:string>>"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_last_wins_and_ranked(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None), (None, 5, "n")], "k string, p int, v string")
    assert rows(relations.last_wins(df, ["k"], F.col("p"))) == rows(spark.createDataFrame([("a", 2, "y"), ("b", 1, None), (None, 5, "n")], "k string, p int, v string"))
    assert relations.last_wins(df.limit(0), ["k"], F.col("p")).count() == 0
    some = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(7)
    assert rows(relations.ranked(some, F.col("x"), "place").where("x != place")) == []
    assert relations.ranked(some.limit(0), F.col("x"), "place").count() == 0


def test_sides_pending_and_positions(spark):
    a, b = spark.createDataFrame([("x",), ("y",), (None,)], "k string"), spark.createDataFrame([("y",), ("z",), ("z",)], "k string")
    assert tuple(relations.one_sided(a, b, "k").first()) == (1, 1, 1)
    assert rows(relations.pending(a.where("k is not null"), [a, b], "k")) == [("x",)]
    assert relations.pending(a, [], "k").count() == 3
    entries = spark.createDataFrame([("e0", 0), ("e1", 1), ("e1", 2)], "id string, pos int")
    results = spark.createDataFrame([("e1", 0), ("??", 1), ("??", 9)], "id string, pos int")
    got = relations.match_or_position(results, entries, "id", "pos").select("id", "pos", "entry.pos")
    assert rows(got) == [("??", 1, 1), ("e1", 0, 2)]


@pytest.mark.parametrize("n, sizes", [(1, (0, 0, 1)), (2, (0, 1, 1)), (3, (1, 1, 1)), (100, (80, 10, 10)), (25, (21, 2, 2))])
def test_group_split_counts(spark, n, sizes):
    df = spark.range(n * 3).select((F.col("id") % n).cast("string").alias("g"))
    got = {r.split: r.n for r in relations.group_split(df, "g", 0.1, 0.1, 42).groupBy("split").agg(F.count_distinct("g").alias("n")).collect()}
    assert tuple(got.get(s, 0) for s in ("train", "eval", "test")) == sizes


def test_samples(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    first = rows(relations.seeded_sample(df, "k", 10, 1))
    assert first == rows(relations.seeded_sample(df.repartition(5), "k", 10, 1)) and len(first) == 10
    assert relations.seeded_sample(df, "k", 99).count() == 50
    assert rows(relations.at_positions(df, "k", [3, 99])) == [(3,)]
    assert rows(relations.from_position(df, "k", 48)) == [(48,), (49,)]
    assert 0 < relations.row_split(df, "k", 0.5).where("held").count() < 50
    assert rows(relations.numbered(df.limit(2), ["k"], "q%02d", start=1)) == [(0, "q01"), (1, "q02")]
    assert rows(relations.latest(df, "k", 2)) == [(48,), (49,)]


def test_similarity_filter(spark):
    base = "the quick brown fox jumps over the lazy dog again and again"
    pairs = spark.createDataFrame([("p_q01", "s", base, base), ("p_q11", "s", base, base), ("p_q02", "s", base, "nothing alike"), ("p_q03", "s", " \n", "x"), ("odd", "s", base, base), ("p_q12", "s", "", "x")], "question_id string, system_prompt_id string, answer_big string, answer_small string")
    types = spark.createDataFrame([("p_q01", "on_topic"), ("odd", "off_topic")], "question_id string, question_type string")
    got = {r.question_id: (r.kept, r.reason, r.off_topic, r.edit_distance is None) for r in curate.similarity_filter(pairs, types).collect()}
    assert got == {
        "p_q01": (False, "too_similar", False, False), "p_q11": (True, "off_topic_preserved", True, False), "p_q02": (True, "kept", False, False), "p_q03": (False, "empty_response", False, True),
        "odd": (True, "off_topic_preserved", True, False), "p_q12": (False, "empty_response", True, True),
    }
    s = curate.filter_stats(curate.similarity_filter(pairs, types)).first()
    assert (s.total, s.kept, s.empty_response, s.too_similar, s.off_topic_kept) == (6, 3, 2, 1, 2)


def test_deficit_and_validation(spark):
    have = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    want = spark.createDataFrame([("a", 2, 0), ("b", 3, 1), ("c", 2, 2)], "k string, target int, pos int")
    assert rows(curate.largest_deficit(have, want, ["k"], "pos")) == [("b", 2)]
    assert rows(curate.largest_deficit(have, want.where("k = 'a'"), ["k"], "pos")) == []
    q = spark.createDataFrame([([("a long one", True, "i"), ("other", False, "i")],), ([("abc", True, "i")],), (None,)], "q array<struct<question:string,on_topic:boolean,intent:string>>").coalesce(1)
    assert [r.v for r in q.select(curate.valid_questions(F.col("q"), 1, 1).alias("v")).collect()] == [True, False, False]


def test_recipes(spark):
    ms = spark.createDataFrame([("q", ["a"], ([0, 1], ["p", "r"])), ("q", [], ([1], ["p"])), ("q", ["a"], ([0], ["p"]))], "query string, answers array<string>, passages struct<is_selected:array<int>,passage_text:array<string>>")
    assert rows(corpus.selected_passages(ms)) == [("p\n\nr", "q", "a")]
    race = spark.createDataFrame([("t", "q", ["w", "x"], "B"), ("t", "q", ["w"], "D")], "a string, q string, o array<string>, l string")
    assert [r.answer for r in corpus.lettered_choice(race, "a", "q", "o", "l").collect()] == ["x", None]
    hot = spark.createDataFrame([([["a.", " b."], ["c."]], "q", "x")], "s array<array<string>>, q string, a string")
    assert corpus.nested_sentences(hot, "s", "q", "a").first().context == "a. b.\n\nc."
    coqa = spark.createDataFrame([("c", ["q1", "q2"], ["a1"]), ("d", [], ["a"])], "c string, q array<string>, a array<string>")
    assert [len(r.conversations) for r in corpus.zipped_turns(coqa, "c", "q", "a").orderBy("context").collect()] == [2, 0]
    quac = spark.createDataFrame([("t", "b", [("q", "CANNOTANSWER")])], "t string, b string, qas array<struct<question:string,answer:string>>")
    assert tuple(corpus.filtered_dialogues(quac, ["t", "b"], "qas").first()) == ("t\n\nb", [])
    g = spark.createDataFrame([(1, " c ", "q2", "w " * 9), (0, "c", "q1", "w w"), (2, "d", "q", "not enough information"), (3, None, "q", "a")], "pos int, c string, q string, a string")
    assert [(r.context, r.first_pos, len(r.pairs)) for r in corpus.grouped_by_text(g, "c", "q", "a", "pos", sentinel="not enough information").collect()] == [("c", 0, 2)]
    trimmed = corpus.grouped_recipe(g, "c", "q", "a", "pos", trim_to=5).orderBy("context").collect()
    assert [(r.context, [m.content for m in r.conversations]) for r in trimmed] == [("c", ["q1", "w w"]), ("d", ["q", "not enough information"])]
    assert [r.context for r in corpus.grouped_recipe(g, "c", "q", "a", "pos", max_total=4).collect()] == ["d"]  # 13 words and 4


def test_recipes_of_odd_rows(spark):
    rows = [(0, "c", "q", ["a"]), (1, " c ", "q2", []), (2, None, "q3", ["x"]), (3, "", None, [None]), (4, "c", "q", ["a"]), (5, "d", "q5", None)]
    duo = spark.createDataFrame(rows, "pos int, plot string, question string, answers array<string>")
    assert rows_of(recipes.build("duorc_paraphrase", duo)) == [("c", ["q", "A"]), ("c", ["q", "A"])]
    assert rows_of(recipes.build("duorc_self_mqa", duo)) == [("c", ["q", "A", "q", "A"])]
    assert len(recipes.RECIPES) == 22 and recipes.build("duorc_self", duo.limit(0)).count() == 0
    long = "w " * 300
    pwc = spark.createDataFrame([(0, "c", "p", long), (1, "c", "p1", "x " * 120), (2, "c", "p2", "y"), (3, "k " * 2049, "p", "y"), (4, "e", "p", long)], "pos int, input string, prompt string, answer string")
    got = {r.context: len(r.conversations) for r in recipes.build("pwc", pwc).collect()}
    assert got == {"c": 4, "e": 0}  # long turns go, long contexts go, an empty conversation stays
    race = spark.createDataFrame([(0, "a", "q", ["w", "x", "y", "z"], "D"), (1, "a", "q", ["w"], "E"), (2, "a", "q", ["w"], "B")], "pos int, article string, question string, options array<string>, answer string")
    assert rows_of(recipes.build("race", race)) == [("a", ["q", "Z"])]


def rows_of(df):
    return sorted((r.context, [m.content for m in r.conversations]) for r in df.collect())


def test_other_contexts(spark):
    df = spark.createDataFrame([(i, f"c{i}") for i in range(5)], "p int, c string")
    got = corpus.with_other_contexts(df, "c", 3, "p", seed=1).collect()
    assert all(len(set(r.c.split("\n\n"))) == 3 and f"c{r.p}" in r.c.split("\n\n") for r in got) and len(got) == 5
    assert all(len(r.c.split("\n\n")) == 5 for r in corpus.with_other_contexts(df, "c", 9, "p").collect())
    assert corpus.with_other_contexts(df.limit(0), "c", 3, "p").count() == 0


def test_chat(spark):
    m = [("system", "s"), ("user", "u1"), ("assistant", "a1"), ("user", "u2"), ("user", "u3"), ("assistant", "a3")]
    df = spark.createDataFrame([(m,), ([],)], f"m {MSG}").coalesce(1)
    r = df.select(chat.render(F.col("m"), True).alias("t"), chat.pairs_of(F.col("m")).alias("p"), chat.turn_replay(F.col("m")).alias("r"), chat.mask_spans(F.col("m")).alias("k")).collect()
    assert r[0].t.endswith("<|im_start|>assistant\na3<|im_end|>\n<|im_start|>assistant\n") and r[1].t == "<|im_start|>assistant\n"
    assert [tuple(x) for x in r[0].p] == [("u1", "a1"), ("u3", "a3")] and [(x.turn, len(x.prompt)) for x in r[0].r] == [(0, 2), (1, 5)]
    assert [x.learn for x in r[0].k] == [False, False, True, False, False, True] and r[1].k == []


def python_mask(ids, start, role, end):
    out = [-100] * len(ids)
    for i in range(len(ids) - 1):
        if ids[i] == start and ids[i + 1] == role:
            j = next((k for k in range(i + 3, len(ids)) if ids[k] == end), len(ids) - 2)
            for k in range(i + 3, min(j + 2, len(ids))):
                out[k] = ids[k]
    return out


def test_label_masks(spark):
    ids = [1, 7, 9, 5, 5, 2, 9, 1, 8, 9, 6, 6, 2, 9, 1, 7, 9, 4]
    df = spark.createDataFrame([(ids,), ([],)], "ids array<int>").coalesce(1)
    got = [r.v for r in df.select(chat.mask_labels(F.col("ids"), 1, 8, 2).alias("v")).collect()]
    assert got == [python_mask(ids, 1, 8, 2), []]
    p = spark.createDataFrame([([1, 2], [3, 4])], "p array<int>, r array<int>").select(chat.prefix_labels(F.col("p"), F.col("r"), 6).alias("a"), chat.prefix_labels(F.col("p"), F.col("r"), 3).alias("b"), chat.suffix_labels(F.col("r"), F.lit(1)).alias("c")).first()
    assert tuple(p.a) == ([1, 2, 3, 4, 0, 0], [-100, -100, 3, 4, -100, -100], [1, 1, 1, 1, 0, 0]) and tuple(p.b) == ([1, 2, 3], [-100, -100, 3], [1, 1, 1]) and p.c == [-100, 4]


def test_articles(spark):
    body = "one two three four five six"
    lines = ["lost", "= A =", body, "", "== B ==", "short", "= C =", body]
    df = spark.createDataFrame(list(enumerate(lines)), "pos int, line string")
    assert [(r.article, r.title, r.text) for r in chat.articles(df, "line", ["pos"]).orderBy("article").collect()] == [(1, "A", body), (3, "C", body)]


def python_first_fit(costs, budget, bins):
    out, held, left = [], [[] for _ in range(bins)], [budget] * bins
    for i, c in enumerate(costs):
        if c > budget:
            out.append([i])
            continue
        j = next((j for j in range(bins) if c <= left[j]), None)
        if j is None:
            j = left.index(min(left))
            if held[j]:
                out.append(held[j])
            held[j], left[j] = [i], budget - c
        else:
            held[j].append(i)
            left[j] -= c
    return out + [h for h in held if h]


@pytest.mark.parametrize("seed", range(12))
def test_first_fit_against_the_plain_rule(seed):
    rng = random.Random(seed)
    costs = [rng.choice([rng.randint(1, 130), 60, 100, 101]) for _ in range(rng.randint(0, 300))]
    bins = rng.choice([1, 2, 3, 7, 100])
    assert grouping.first_fit(costs, 100, bins) == python_first_fit(costs, 100, bins)


def test_packing_tables(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([5, 50, None, 200, 89, 90])], "pos int, n int")
    b = grouping.greedy_pack(df, "pos", F.col("n"), 100)
    assert sorted(r.pos for r in b.collect()) == list(range(6))
    assert all(r.c <= 100 or r.k == 1 for r in b.groupBy("bin").agg(F.sum("cost").alias("c"), F.count("*").alias("k")).collect())
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "pos int, t string")
    assert sum(len(r.texts) for r in grouping.bin_texts(b, texts, "pos", "t").collect()) == 6
    assert grouping.without_members(b, texts.where("pos < 5"), "pos").count() == 1
    assert grouping.greedy_pack(df.limit(0), "pos", F.col("n"), 100).count() == 0
    g = grouping.random_groups(spark.range(11).withColumnRenamed("id", "k"), "k", F.lit(10), 28, 1)
    assert sorted(r["count"] for r in g.groupBy("group_id").count().collect()) == [2, 3, 3, 3]


def test_profiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (float("nan"),), (None,), (float("inf"),)], "x double")
    r = df.agg(*profile.stat_pack(F.col("x"))).first()
    assert (r.n, r.mean, r.median, round(r.p10, 6)) == (4, 4.25, 3.0, 1.3)
    assert df.limit(0).agg(*profile.stat_pack(F.col("x"))).first().mean is None
    assert [x for x in df.limit(0).agg(*profile.weighted_loss(F.col("x"), F.col("x"))).first()] == [0.0, 1.0]
    s = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 0.0), ("b", 0, 1.0)], "c string, t int, f double")
    assert rows(profile.per_turn(s, "c", "t", "f", 2)) == [(0, 1.0, 1, 0.5), (1, 0.0, 1, 0.0)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "k int, v array<double>")
    assert profile.vector_stats(v, "k", "v").first().cos_mean == 0.0


def test_sources(spark, tmp_path):
    p = str(tmp_path / "a.jsonl")
    with open(p, "w") as f:
        f.write('{"a": 1, "b": "x"}\n\n{bad\n{"a": 2}\n')
    assert rows(jsonl.read_jsonl(spark, p, "a int, b string")) == [(1, "x"), (2, None)]
    assert jsonl.read_jsonl(spark, str(tmp_path / "none"), "a int").count() == 0
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, p, "a int, b string", strict=True).collect()
    assert tuple(jsonl.corrupt_lines(spark, p, "a int").first()) == (3, 1)
    out = str(tmp_path / "out")
    jsonl.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), out)
    jsonl.write_jsonl(spark.createDataFrame([(2, "é")], "a int, b string"), out, append=True)
    assert rows(jsonl.read_jsonl(spark, out, "a int, b string")) == [(1, None), (2, "é")]
    array = str(tmp_path / "x.json")
    jsonl.write_json_array(spark.createDataFrame([(2,), (1,)], "a int"), array, ["a"])
    assert json.load(open(array)) == [{"a": 1}, {"a": 2}] and rows(jsonl.read_json_array(spark, array, "a int")) == [(1,), (2,)]
    with open(array, "w") as f:
        json.dump({"data": [{"a": 1, "b": {"c": ["z"]}}]}, f)
    assert jsonl.read_json_array(spark, array, "a int, b struct<c:array<string>>", under="data").first().b.c == ["z"]
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    assert jsonl.cached(build, spark, str(tmp_path / "c")).count() == 3 and jsonl.cached(build, spark, str(tmp_path / "c")).count() == 3 and len(calls) == 1
    parts = [str(tmp_path / f"rank{k}") for k in range(3)]
    for k, part in enumerate(parts[:2]):
        jsonl.write_jsonl(spark.createDataFrame([(i, f"{k}{i}") for i in (2, 0, 1)], "a int, b string"), part)
    merged = jsonl.merge_parts(spark, parts, "a int, b string", "a")
    assert merged.columns == ["b"] and [r.b for r in merged.collect()] == ["00", "10", "01", "11", "02", "12"]
    assert jsonl.merge_parts(spark, parts[2:], "a int, b string", "a").count() == 0
    stats = str(tmp_path / "stats.json")
    jsonl.write_stats(spark.createDataFrame([(1, None)], "n int, mean double"), stats)
    assert json.load(open(stats)) == {"n": 1, "mean": None}
    log = str(tmp_path / "log")
    jsonl.append_scalars(spark.createDataFrame([(1, 0.5, None), (2, 0.25, 3.0)], "step int, loss double, lr double"), log, "step", ["loss", "lr"])
    assert rows(jsonl.read_jsonl(spark, log, "step long, tag string, value double")) == [(1, "loss", 0.5), (2, "loss", 0.25), (2, "lr", 3.0)]
    made = spark.createDataFrame([(5, "b", [("user", "q")]), (4, "a", [])], "k int, context string, conversations array<struct<role:string,content:string>>")
    jsonl.write_records(made, str(tmp_path / "rec"), "x", ["k"])
    assert rows(jsonl.read_jsonl(spark, str(tmp_path / "rec"), "id string, context string")) == [("x.0000", "a"), ("x.0001", "b")]
    template = str(tmp_path / "t.txt")
    open(template, "w").write("Write {n}\nlines")
    assert jsonl.read_template(spark, template) == "Write {n}\nlines"


def test_rolling_over_block_boundaries(spark):
    rng = random.Random(1)
    data = [(rng.choice("aab"), i, rng.choice([None, *range(9)])) for i in range(300)]
    df = spark.createDataFrame(data, "g string, i int, x int")
    for size, block in ((1, 7), (5, 5), (12, 20), (50, 1000)):
        got = {r.i: (r.roll_n, r.roll_sum, r.roll_max) for r in profile.rolling(df, ["g"], ["i"], "x", size, block).collect()}
        assert len(got) == 300
        for g in "ab":
            seen = []
            for _, i, x in sorted((r for r in data if r[0] == g), key=lambda r: r[1]):
                seen.append(x)
                last = [v for v in seen[-size:] if v is not None]
                assert got[i] == (len(last), sum(last) if last else None, max(last, default=None))
    assert profile.rolling(df.limit(0), ["g"], ["i"], "x").count() == 0


def test_bags_and_trigrams(value):
    assert sorted(value(scoring.numbered(F.split(F.lit("b a b a b"), " ")))) == ["a 1", "a 2", "b 1", "b 2", "b 3"] and value(scoring.numbered(F.array().cast("array<string>"))) == []
    assert value(scoring.bag_overlap(F.split(F.lit("a a b c"), " "), F.split(F.lit("a b b a a"), " "))) == 3
    assert value(scoring.char_trigrams(F.lit("abcabc"))) == ["abc", "bca", "cab"] and value(scoring.char_trigrams(F.lit("😀bc"))) == ["😀bc"] and value(scoring.char_trigrams(F.lit("ab"))) == ["ab"]
    assert value(scoring.char_trigrams(F.lit(""))) == [] and value(scoring.char_trigrams(F.lit(None).cast("string"))) is None


def test_question_json(value):
    q = lambda **k: json.dumps([{"question": "How so?", "on_topic": True, "difficulty": None, "intent": "", **k}])
    ok = lambda x: value(curate.valid_question_json(F.lit(x), 1, 0))
    assert ok(q()) and not ok(q(question="Why?")) and not ok(q(question=12345)) and not ok(q(on_topic=False)) and not ok(q(on_topic="yes"))
    assert not ok('[{"question": "How so?", "on_topic": true, "intent": "x"}]') and not ok("[]") and not ok("no json") and not ok(None)


def test_resumable_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    jsonl.write_jsonl(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), src)
    step = lambda df: df.withColumn("w", F.col("v") * 2)
    append_stream(spark, src, "k string, v int", step, out, ck, "k").awaitTermination()
    jsonl.write_jsonl(spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int"), src, append=True)
    append_stream(spark, src, "k string, v int", step, out, ck, "k").awaitTermination()
    assert rows(spark.read.parquet(out).select("k", "w")) == [("a", 2), ("b", 4), ("c", 6)]


def test_quantiles_against_percentile(spark):
    rng = random.Random(5)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), rng.randint(0, 5) / 2, rng.random()])) for _ in range(400)] + [("c", None), ("d", 7.5)]
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    got = {r.g: (r.n, round(r.p, 9), round(r.q, 9), r.z, r.o) for r in profile.quantiles(df, ["g"], F.col("x"), {"p": 0.5, "q": 0.13, "z": 0.0, "o": 1.0}).collect()}
    want = df.where("x is not null and not isnan(x)").groupBy("g").agg(F.count("x").alias("n"), F.percentile("x", 0.5).alias("p"), F.percentile("x", 0.13).alias("q"), F.min("x").alias("z"), F.max("x").alias("o"))
    assert got == {r.g: (r.n, round(r.p, 9), round(r.q, 9), r.z, r.o) for r in want.collect()} and "c" not in got
    stats = {r.g: r for r in profile.stat_table(df, ["g"], F.col("x")).collect()}
    assert stats["c"].n == 0 and stats["c"].median is None and stats["d"].p90 == 7.5 and stats[None].n == got[None][0]
    assert profile.quantiles(df.limit(0), ["g"], F.col("x"), {"p": 0.5}).count() == 0
