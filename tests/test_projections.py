import json

from pyspark.sql import functions as F

from weftline.operators import projections as P


def test_adversarial_defaults(spark):
    df = spark.createDataFrame([(0, "c", "q", None, "x"), (11, "c", "q", 3.5, None)], "pos int, context string, question string, difficulty_weight double, category string")
    got = [(r.question_id, r.system_prompt_id, r.category, r.difficulty_weight, r.answer_8b) for r in P.adversarial_rows(df, "pos").orderBy("question_id").collect()]
    assert got == [("adv_001", "sp_ADV01", "x", 3.0, ""), ("adv_012", "sp_ADV12", "adversarial", 3.5, "")]


def test_method_texts(spark):
    raw = {"id": "1", "system_prompt": "s", "a": {"response": {"answer": "x"}}, "b": {"answer": "y"}, "c": "z", "d": 3, "e": {"response": {}}, "f": None}
    df = spark.createDataFrame([(1, json.dumps(raw)), (2, "no json"), (3, None)], "k int, raw string")
    assert sorted(tuple(r) for r in P.method_texts(df, "k", "raw").collect()) == [(1, "a", "x"), (1, "b", "y"), (1, "c", "z"), (1, "e", "")]


def test_spans_variants_and_groups(spark):
    df = spark.createDataFrame([(" c ", "q", [" yes", "ÉA", ""], 1)], "c string, q string, a array<string>, k int")
    assert tuple(P.span_question(df, "c", "q", "a").first()) == ("c", "q", ["Yes", "ÉA", ""])
    v = P.variants(spark.createDataFrame([(1, "a", None)], "k int, x string, y string"), ["k"], ["x", "y"])
    assert sorted((r.k, r.variant, r.conversation) for r in v.collect()) == [(1, 0, "a"), (1, 1, None)]
    g = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "k int, group_id int")
    assert sorted(tuple(r) for r in P.group_members(g, "k").collect()) == [(1, 7, 2, 1), (2, 7, 2, 1), (3, 8, 1, 3)]
    m = spark.range(1).select(P.messages_with_context(F.lit("c"), F.lit("q")).alias("m")).first().m
    assert [tuple(x) for x in m] == [("system", "c"), ("user", "q")]
    assert P.distill_rows(spark.createDataFrame([("c", "q", "a", None)], "context string, question string, answer string, difficulty_weight double")).first().difficulty_weight == 1.0
