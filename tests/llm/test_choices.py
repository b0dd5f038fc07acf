"""Packing, mixing and languages."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import language, mixing, packing
from weftline.functions.tokens import VOCABULARY, count_tokens, encoding


def check_packed(rows, sizes, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.container, []).append(r)
    assert all(sum(x.tokens for x in v) == v[0].fill <= capacity for v in by.values())
    for i, n in sizes.items():
        mine = sorted((r.start, r.tokens) for r in rows if r.id == i)
        assert sum(t for _, t in mine) == n and (len(mine) == 1 or n > capacity)
        assert [s for s, _ in mine] == [k * capacity for k in range(len(mine))]
    return len(by)


def test_pack(spark):
    rng = random.Random(3)
    sizes = {i: rng.choice([rng.randint(1, 60), rng.randint(20, 99), 250, 100, 0]) for i in range(400)}
    df = spark.createDataFrame([*[(i, n, 0) for i, n in sizes.items()], (5, sizes[5], 0), (None, 3, 0)], "item_id long, n int, id int")
    rows = packing.pack(df, "item_id", F.col("n"), 100, shard=120).collect()
    n = check_packed(rows, sizes, 100)
    least = math.ceil(sum(sizes.values()) / 100)
    assert least <= n <= 1.02 * least + 1
    r = packing.fill_report(packing.pack(df, "item_id", F.col("n"), 100), 100).first()
    assert r.tokens == sum(sizes.values()) and r.least_containers == least
    assert packing.pack(df.limit(0), "item_id", F.col("n"), 100).count() == 0
    twice = spark.createDataFrame([(1, 100), (1, 200), (2, 300), (2, 300), (1, 1500)], "item_id long, n int")
    got = sorted((x.id, x.length, x.piece, x.tokens) for x in packing.pack(twice, "item_id", F.col("n"), 1000).collect())
    assert got == [(1, 100, 0, 100), (1, 200, 0, 200), (1, 1500, 0, 1000), (1, 1500, 1, 500), (2, 300, 0, 300)]
    assert [(x.tokens, x.fill) for x in packing.pack(spark.createDataFrame([(1, None)], "i int, n int"), "i", F.col("n"), 10).collect()] == [(0, 0)]


def test_operators_of_the_genetic_algorithm():
    rng = random.Random(0)
    sizes = [rng.randint(5, 70) for _ in range(150)]
    whole = lambda bins: sorted(i for b in bins for i in b) == list(range(150)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
    a = packing.best_fit(list(range(150)), sizes, 100, [])
    b = packing.mutate(a, sizes, 100, rng)
    c = packing.crossover(a, b, sizes, 100, rng)
    assert whole(a) and whole(b) and whole(c)
    best = packing.evolve(sizes, 100, [a], random.Random(1))[0]
    assert whole(best) and packing.fitness(best, sizes, 100) >= packing.fitness(a, sizes, 100)
    assert packing.evolve([], 100, [], rng) == [[]]


def test_tokens(spark):
    df = spark.createDataFrame([(1, ["Hello world", None, ""]), (2, None), (3, [])], "k int, t array<string>")
    assert sorted((r.k, r.tokens) for r in count_tokens(df, ["k"], F.col("t")).collect()) == [(1, 2), (2, 0), (3, 0)]
    e = encoding(VOCABULARY)
    assert e.decode(e.encode_ordinary("Grüße, мир! 😀")) == "Grüße, мир! 😀"


def test_temperature():
    t = {"a": 900.0, "b": 90.0, "c": 10.0}
    assert mixing.tempered(t, 1.0)["a"] == pytest.approx(0.9) and mixing.tempered(t, 0.0)["c"] == pytest.approx(1 / 3)
    want = 0.8 * math.log(3)
    x = mixing.exponent_for_entropy(t, want)
    assert mixing.entropy(list(mixing.tempered(t, x).values())) == pytest.approx(want, abs=1e-6)
    x = mixing.exponent_for_repeats(t, 1000, {s: 4 for s in t})
    w = mixing.tempered(t, x)
    assert all(w[s] * 1000 <= 4 * t[s] * (1 + 1e-6) for s in t) and w["c"] == pytest.approx(0.04, rel=1e-3)
    x, s = mixing.lean_to_natural({"a": 0.2, "b": 0.4, "c": 0.4}, t, 500, {"a": 1, "b": 2, "c": 4})
    assert 0 < x < 1 and all(s[k] * 500 <= lim * t[k] * (1 + 1e-6) for k, lim in (("a", 1), ("b", 2), ("c", 4)))
    limits = {"a": 1, "b": 2, "c": 4, "gone": 9}
    # all in reach: the targets themselves
    assert mixing.fitted_weights({"a": 0.9, "b": 0.08, "c": 0.02}, t, 500, limits) == (0.0, pytest.approx({"a": 0.9, "b": 0.08, "c": 0.02}))
    # c gives all it may (40 of 500), the others share the rest as the targets say
    x, w = mixing.fitted_weights({"a": 0.6, "b": 0.2, "c": 0.2}, t, 500, limits)
    assert x == 0.0 and w == pytest.approx({"c": 0.08, "a": 0.69, "b": 0.23})
    # b would be repeated too often by what c leaves, so a and b lean to their natural shares
    x, w = mixing.fitted_weights({"a": 0.3, "b": 0.3, "c": 0.4}, t, 550, limits)
    assert 0 < x < 1 and math.fsum(w.values()) == pytest.approx(1) and w["b"] * 550 <= 180 * (1 + 1e-6) and w["b"] * 550 == pytest.approx(180, rel=1e-3)
    # more than there is: all that may be taken
    assert mixing.fitted_weights({"a": 0.5, "b": 0.5, "gone": 0.0}, t, 10_000, limits)[1] == pytest.approx({"a": 0.09, "b": 0.018})
    assert mixing.fitted_weights({"gone": 1.0}, t, 10, limits)[1] == {} == mixing.fitted_weights({}, t, 0, limits)[1]


def test_mix(spark):
    rng = random.Random(1)
    docs = [(i, "word " * rng.randint(1, 40), s) for i, s in enumerate(["big/train"] * 300 + ["BIG_TRAIN "] * 30 + ["small/test"] * 12 + [None, "", "other"])]
    docs += [(1000, None, "big/train"), (1001, "", "big/train")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, source string, key string")
    targets = spark.createDataFrame([("big/train", 0.6, 1), ("small/test", 0.3, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    sized = {r.doc_id: r.tokens for r in mixing.sized(df, None).collect()}
    small = sum(n for i, n in sized.items() if 330 <= i < 342)
    total = int(small * 2.5 / 0.3)
    rows = mixing.mix(df, targets, total_tokens=total).collect()
    got = {s: sum(r.tokens * r.repeats for r in rows if r.source == s) for s in ("big/train", "small/test")}
    # the tenth of the source that has no rows goes to the others
    assert abs(got["big/train"] - 0.6 / 0.9 * total) <= 30 and abs(got["small/test"] - 0.3 / 0.9 * total) <= 30
    assert all(1 <= r.repeats <= (1 if r.source == "big/train" else 3) for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    assert all(r.reached_share == pytest.approx(got[r.source] / sum(got.values())) for r in rows)
    report = {r.source: r for r in mixing.mix_report(mixing.mix(df, targets, total_tokens=total), targets).collect()}
    assert report["gone"].tokens == 0 and report["small/test"].most_repeats == 3
    over = mixing.mix(df, targets, total_tokens=100 * total).collect()
    assert max(r.repeats for r in over if r.source == "small/test") == 3 and max(r.repeats for r in over if r.source == "big/train") == 1
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0
    old = mixing.BLOCK_ROWS
    mixing.BLOCK_ROWS = 20
    try:
        again = mixing.mix(df, targets, total_tokens=total).collect()
        assert abs(sum(r.tokens * r.repeats for r in again if r.source == "big/train") - 0.6 / 0.9 * total) <= 30
    finally:
        mixing.BLOCK_ROWS = old
    warm = mixing.temperature_mix(df).collect()
    assert warm and max(r.repeats for r in warm) <= 4


LABELS = {"en": 1, "EN": 1, " en-US ": 1, "eng": 1, "English": 1, "en_GB": 1, "de": 0, "xx": None, "und": None, "": None, None: None, "??": None, "n/a": None, "mul": None, "unknown": None}


def test_language_codes(spark):
    df = spark.createDataFrame([(k,) for k in LABELS], "lang string").coalesce(1)
    got = [r.c for r in df.select(language.language_code(F.col("lang")).alias("c")).collect()]
    assert got == ["en" if v == 1 else "de" if v == 0 else None for v in LABELS.values()]


def test_segments_cover_the_text():
    t = "One two. Three 3.5 four!  Five…\n\nSix\nseven?"
    assert [t[a:b].strip() for a, b in language.segments(t)] == ["One two.", "Three 3.5 four!", "Five…", "Six", "seven?"]
    assert language.segments("") == [] and language.segments("\n\n") == []


def test_detection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    assert model.languages == ["de", "en", "es", "fr", "it", "nl", "pt", "ru"]
    en = "The wooden ledger in Elvimora was approved by candlelight, and the quiet curator followed on foot. "
    de = "Die lange Brücke ordnet das dunkle Glas hinter der Mühle, aber niemand hat es bemerkt. "
    rows = [(1, en * 3, "en"), (2, en * 2 + de * 2, "en"), (3, de * 2, "English"), (4, en, None), (5, None, "en"), (6, "", "en"), (7, "x1 y2 {}", "und"), (8, de, "deu"), (9, en + "A song named «Die lange Brücke» was popular in the old town near the mill. " + en, "EN"), (10, en * 20000, "eng")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, lang string, label string")
    found = language.detect(df, model)
    got = {r.doc_id: r for r in found.collect()}
    assert [got[i].lang for i in range(1, 11)] == ["en", "en", "de", "en", None, None, None, "de", "en", "en"]
    assert [p.lang for p in got[2].passages] == ["en", "de"] and got[2].passages[1].words == 30 and 0.5 < got[1].confidence <= 1
    assert rows[1][1][got[2].passages[1].start :].strip().startswith("Die lange")
    assert sorted(tuple(r) for r in language.mislabelled(found).collect()) == [(2, "de"), (2, "en"), (3, "de"), (4, "en")]
    assert language.detect(df.limit(0), model).count() == 0
    # short lines: pooled where nothing longer stands, else counted with the passage they are part of
    lines = "The old bridge\nwas closed\nby the council\nin the morning\nbecause of rain\nand the wind"
    mixed = de + "Hinter der Mühle? " + "Aber niemand hat es bemerkt."
    short = spark.createDataFrame([(1, lines, "de"), (2, "the old bridge", None), (3, mixed, "de"), (4, "x\ny\n?\n", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.detect(short, model).collect()}
    assert [got[i].lang for i in (1, 2, 3)] == ["en", "en", "de"] and sum(p.words for p in got[1].passages) == 17
    assert 20 <= sum(p.words for p in got[3].passages) <= 23  # the three words count if they are taken for German
    assert language._pooled([(0, 1), (2, 5), (6, 7), (8, 9), (10, 30), (31, 32)], [["a"], ["b", "c"], [], ["d"], list("vwxyz"), ["e"]]) == ([(0, 9), (10, 30), (31, 32)], [["a", "b", "c", "d"], list("vwxyz"), ["e"]])
    assert [tuple(r) for r in language.mislabelled(language.detect(short, model)).collect()] == [(1, "en")]


def test_lengths_are_exact(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs)
    texts = [["the", "old", "mill", "the"], ["Brücke".lower(), "12", "und"], ["x"]]
    got = language.Scorer(model).cosines(texts)
    for w, row in zip(texts, got):
        of, bucket = language.grams([x for x in w if not x.isdigit()])
        v = np.bincount(bucket, minlength=1 << language.BITS) * model.idf
        assert np.allclose(row, np.bincount(bucket, minlength=1 << language.BITS) @ model.table / np.linalg.norm(v), atol=1e-4)


def test_held_out_accuracy(spark):
    """Trained on half of the rows, asked about right-labelled rows of the other half."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    d = language.detect(docs.where("doc_id % 2 = 1"), model).where("label is not null and lang is not null")
    n, ok = d.count(), d.where("label = lang").count()
    assert n > 300 and ok / n > 0.9  # about one label in twenty is wrong
