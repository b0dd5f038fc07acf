"""Pairs, groups, splits and leaks against brute force on small fixtures."""

import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.llm import components, cross_split, leakage, near_duplicates, splits
from weftline.llm.words import bag_elements, near_same, prefix_length, raw_words, words

VOCAB = [f"w{i}" for i in range(300)] + ["the", "of", "a", "and"] * 40


def text(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(rng, t, rate):
    w = [x for x in t.split() if rng.random() > rate / 2]
    w = [rng.choice(VOCAB) if rng.random() < rate / 2 else x for x in w]
    if rng.random() < 0.4:
        rng.shuffle(w)
    return " ".join(w)


def test_words():
    assert words("It's A-1_b É") == ["it", "s", "a", "1", "b", "é"] and words(None) == []
    for t in ("Ça va «bien» ²x µ", "naïve—test", "Привет, мир", ""):
        assert [w.decode("latin-1") if isinstance(w, bytes) else w for w in raw_words(t)] == words(t)
    assert near_same(["a"] * 4 + ["b"], ["a"] * 5) and not near_same(["a"] * 4, ["a"] * 3) and not near_same([], [])
    assert [prefix_length(n) for n in (1, 5, 10)] == [1, 2, 3]
    e = bag_elements(np.array([5, 5, 7], np.uint64))
    assert len(set(e.tolist())) == 3


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 120).astype(np.uint64)
    sets = [base, np.concatenate([base[:90], rng.integers(0, 1 << 62, 30).astype(np.uint64)]), base[:1]]
    s = near_duplicates.sketch(sets, 640)
    assert abs((s[0] == s[1]).mean() - 90 / 150) < 0.1 and (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_near_duplicate_pairs_against_brute_force(spark):
    rng = random.Random(4)
    base = [text(rng, rng.randint(8, 120)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, edited(rng, rng.choice(base), rng.choice([0.05, 0.15, 0.25]))) for i in range(120)]
    rows += [(300, None), (301, ""), (302, "?!"), (303, "?!"), (304, base[0]), (305, base[0].upper()), (305, base[0].upper())]
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "item_id long, context string, id long")
    truth = {(a[0], b[0]) for a, b in combinations(sorted(set(rows), key=lambda r: r[0]), 2) if near_same(words(a[1]), words(b[1]))}
    got = [(r.id_a, r.id_b) for r in near_duplicates.near_duplicate_pairs(df, "item_id", "context").collect()]
    assert len(got) == len(set(got)) and set(got) <= truth
    assert len(set(got)) >= 0.99 * len(truth)  # the least similar are found with a probability
    exact = [(r.id_a, r.id_b) for r in near_duplicates.near_duplicate_pairs(df, "item_id", "context", exact=True).collect()]
    assert len(exact) == len(set(exact)) and set(exact) == truth
    groups = {r.id: r for r in near_duplicates.near_duplicate_groups(df, "item_id", "context").collect()}
    assert groups[0].rep == groups[304].rep == groups[305].rep == 0 and groups[0].copies == 3
    assert all(groups[a].group_id == groups[b].group_id for a, b in got)
    assert not {300, 301, 302, 303} & set(groups)
    assert near_duplicates.near_duplicate_pairs(df.limit(0), "item_id", "context").count() == 0


def test_parities_never_exceed_the_difference(spark):
    rng = np.random.default_rng(8)
    rows = []
    for n in (1, 40, 63, 64, 65, 250, 700):
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.concatenate([a[: n - n // 6], rng.integers(0, 1 << 62, n // 5).astype(np.uint64)])
        rows.append((near_duplicates.parity(a).tolist(), near_duplicates.parity(b).tolist(), len(set(a.tolist()) ^ set(b.tolist()))))
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, d int")
    got = df.select(near_duplicates._differ(F.col("x"), F.col("y")).alias("n"), "d", (F.size("x") != F.size("y")).alias("folded")).collect()
    assert all(0.5 * r.d <= r.n <= r.d for r in got) and any(r.folded for r in got)


@pytest.mark.parametrize("batch", [1, 2, 3, 7, 1000])
def test_runs_of_equal_keys_across_batches(batch):
    rng = random.Random(batch)
    rows = sorted((k, i) for k in range(12) for i in rng.sample(range(40), [1, 2, 3, 5, 9, 17][k % 6]))
    pdf = pd.DataFrame({"id": [i for _, i in rows], "key": [k for k, _ in rows]})
    out = pd.concat(near_duplicates._meet(6)(pdf.iloc[lo : lo + batch] for lo in range(0, len(pdf), batch)))
    by = {k: {i for x, i in rows if x == k} for k in range(12)}
    hot = {(r.key, r.a) for r in out[out.b < 0].itertuples()}
    assert {k for k, _ in hot} == {k for k, v in by.items() if len(v) > 6} and all(i in by[k] for k, i in hot)
    pairs = {(r.a, r.b) for r in out[out.b >= 0].itertuples()}
    hot_pairs = {p for k in by for p in combinations(sorted(i for x, i in hot if x == k), 2)}
    assert pairs | hot_pairs == {p for v in by.values() for p in combinations(sorted(v), 2)}
    assert all(by[k] == {i for x, i in hot if x == k} for k, _ in hot)


def test_least_similar_pairs_are_found(spark):
    # four fifths in common, all differences among the rare words
    every = [f"e{i}" for i in range(80)]
    rows = [(2 * k + side, " ".join(every + [f"r{k}x{side}x{i}" for i in range(20)])) for k in range(300) for side in (0, 1)]
    # everyday words differ from pair to pair, so that only the two of a pair are near
    rows = [(i, t.replace("e", f"e{i // 2 % 300}y")) for i, t in rows]
    # what the pairs share stands in other texts too
    rows += [(1000 + 2 * k + j, " ".join(f"e{k}y{i}" for i in range(80)) + " " + " ".join(f"z{k}x{j}x{i}" for i in range(60))) for k in range(300) for j in (0, 1)]
    df = spark.createDataFrame(rows, "item_id long, context string")
    got = {(r.id_a, r.id_b) for r in near_duplicates.near_duplicate_pairs(df, "item_id", "context").collect()}
    want = {(2 * k, 2 * k + 1) for k in range(300)}
    assert got == want
    assert {(r.id_a, r.id_b) for r in near_duplicates.near_duplicate_pairs(df, "item_id", "context", exact=True).collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(500, 500), (7, None)] + [(1000, 1001 + i) for i in range(40)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in components.hash_to_min(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_components_of_nothing(spark):
    assert components.hash_to_min(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cross_split_against_brute_force(spark):
    rng = random.Random(9)
    ctx = [text(rng, 40) for _ in range(12)]
    qs = [text(rng, rng.randint(4, 14)) for _ in range(30)]
    rows = []
    for i in range(260):
        c, q = rng.choice(ctx), rng.choice(qs)
        rows.append((i, rng.choice(["train", "train", "eval", "test ", "TRAIN", None]), edited(rng, c, rng.choice([0, 0, 0.1, 0.3])), edited(rng, q, rng.choice([0, 0, 0.1, 0.3]))))
    rows += [(900, "train", None, "q"), (901, "eval", "c", None), (902, "eval", "", ""), (903, "train", "", "")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "example_id long, split string, context string, question string, id int")
    side = lambda s: None if s is None else s.strip().lower()
    truth = {(a[0], b[0], side(b[1])) for a in rows if side(a[1]) == "train" for b in rows if side(b[1]) not in (None, "train") if near_same(words(a[2]), words(b[2])) and near_same(words(a[3]), words(b[3]))}
    got = [tuple(r) for r in cross_split.cross_split_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == truth and truth
    partners = {h: {t for t, x, _ in truth if x == h} for _, h, _ in truth}
    by_id = {r[0]: r for r in rows}
    record = lambda i: (by_id[i][2], by_id[i][3])
    covered = {r.id: r for r in cross_split.cross_split_coverage(df).collect()}
    assert set(covered) == set(partners)
    for h, r in covered.items():
        assert r.links == len({record(t) for t in partners[h]}) and 0.8 <= r.coverage <= 1 and r.verbatim <= r.coverage + 1e-9 and r.stretches >= 1
        assert r.train_rep in partners[h] and record(r.rep) == record(h)
    assert cross_split.cross_split_pairs(df.limit(0)).count() == 0


def test_split_prompts(spark):
    rows = [("sp_00001", "sp_00001_q1", "train"), (" SP-1\t", "sp_00001_q2", "test"), ("sp_00002", "sp_00002_q1", "train"), (None, "sp_00002_q3", "eval"), ("sp_00003", "x", "train"), ("Sp00003", "x", "TRAIN "), ("", "sp_00004_q1", "train"), ("sp_4", "y", "test"), (None, None, "test"), ("sp_00005", "z", None), ("sp_00005", "z", "test"), ("zz_9", "q", "test"), ("ZZ 09", "q", "eval")]
    ex = spark.createDataFrame([(*r, 1) for r in rows], "system_prompt_id string, question_id string, split string, id int")
    prompts = spark.createDataFrame([(f"sp_0000{i}",) for i in range(1, 6)], "id string")
    got = sorted(r[0] for r in splits.split_prompts(ex, prompts).collect())
    assert got[:1] == ["ZZ 09"] and got[1:] == ["sp_00001", "sp_00002", "sp_00004"]
    assert splits.split_prompts(ex.limit(0), prompts).count() == 0


def test_assignment_keeps_prompts_whole_and_shares(spark):
    rng = random.Random(2)
    rows = []
    for p in range(400):
        n = 900 if p == 7 else rng.randint(1, 12)
        rows += [(rng.choice([f"sp_{p:05d}", f"SP-{p}", None]), f"sp_{p:05d}_q{k}", ["a", "b ", None][p % 3]) for k in range(n)]
    ex = spark.createDataFrame(rows, "system_prompt_id string, question_id string, category string")
    targets = spark.createDataFrame([("train", 0.8), ("eval", 0.1), ("test", 0.1)], "split string, target_share double")
    got = splits.assign_splits(ex, targets).collect()
    assert len(got) == 400 and len({r.system_prompt_id for r in got}) == 400 and sum(r.n for r in got) == len(rows)
    for c in {r.category for r in got}:
        total = sum(r.n for r in got if r.category == c)
        for s, want in (("train", 0.8), ("eval", 0.1), ("test", 0.1)):
            assert abs(sum(r.n for r in got if r.category == c and r.split == s) / total - want) < 0.03
    per = {}
    each = splits.assigned_rows(ex.withColumn("example_id", F.monotonically_increasing_id()), splits.assign_splits(ex, targets), "example_id").collect()
    for r in each:
        per.setdefault(r.system_prompt_id, set()).add(r.split)
    assert len(each) == len(rows) and len(per) == 400 and all(len(v) == 1 for v in per.values())
    assert splits.assign_splits(ex.limit(0), targets).count() == 0


def test_records_tied_by_one_row_stay_together(spark):
    # sp_1 - sp_2 by a row that names one and asks the other's question, sp_2 - sp_3 by a context; sp_4 stands alone
    rows = [("sp_00001", "sp_00001_q1", "x"), ("SP-1", "sp_2_q2", "x"), ("sp_2", "sp_2_q1", "same"), (None, "sp_00003_q7", "same"), ("sp_3", None, "y"), ("sp_4", "sp_4_q1", None), (None, None, "y"), (None, None, None)]
    ex = spark.createDataFrame([(i, *r, "k") for i, r in enumerate(rows)], "example_id long, system_prompt_id string, question_id string, context string, category string")
    targets = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split string, target_share double")
    for seed in range(2):
        placed = splits.assign_splits(ex, targets, seed=seed, also=("context",))
        got = {r.system_prompt_id: r for r in placed.collect() if r.system_prompt_id}
        assert set(got) == {"sp1", "sp2", "sp3", "sp4"} and len({got[k].component for k in ("sp1", "sp2", "sp3")}) == 1 and got["sp4"].component == "p:sp4"
        each = {r.example_id: r.split for r in splits.assigned_rows(ex, placed, "example_id", also=("context",)).collect()}
        assert len(each) == len(rows) and len({each[i] for i in (0, 1, 2, 3, 4, 6)}) == 1 and each[7] is not None
    # without the context as a key only the first tie is left
    loose = {r.system_prompt_id: r.component for r in splits.assign_splits(ex, targets).collect()}
    assert loose["sp1"] == loose["sp2"] != loose["sp3"]
    assert not splits.assign_splits(ex, targets.limit(0)).where("split is not null").count()


def test_every_category_has_weights_of_its_own(spark):
    comps = spark.range(12_000).selectExpr("cast(id as string) as component", "cast(id div 1 as string) as category", "id % 3 + 1 as n")
    many = comps.unionAll(spark.range(600).selectExpr("concat('a', id)", "'one'", "id % 5 + 1"))
    got = splits.rendezvous(many, {"train": 0.7, "test": 0.3}, passes=6).groupBy("category", "split").agg(F.sum("n").alias("n")).where("category = 'one'").collect()
    n = {r.split: r.n for r in got}
    assert abs(n["train"] / sum(n.values()) - 0.7) < 0.02


def brute_leak(doc, item):
    """The definition, by tables of edit distances from every start in the item."""
    runs = {tuple(item[k : k + 12]) for k in range(len(item) - 11)}
    if any(tuple(doc[k : k + 12]) in runs for k in range(len(doc) - 11)):
        return True
    for i0 in range(len(item) - 24):
        prev = [0] * (len(doc) + 1)
        for i in range(i0, len(item)):
            cur = [prev[0] + 1]
            for j in range(1, len(doc) + 1):
                cur.append(min(prev[j - 1] + (doc[j - 1] != item[i]), prev[j] + 1, cur[j - 1] + 1))
            prev = cur
            if i - i0 + 1 >= 25 and min(prev) * 8 <= i - i0 + 1:
                return True
    return False


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    items = [(i, text(rng, rng.choice([8, 11, 12, 26, 40, 70]))) for i in range(14)]
    docs = []
    for d in range(70):
        w = text(rng, rng.randint(10, 60)).split()
        src = rng.choice(items)[1].split()
        n = rng.choice([11, 12, 13, 25, 30, 60])
        at = rng.randint(0, max(0, len(src) - n))
        part = src[at : at + n]
        for _ in range(rng.choice([0, 0, 1, 3, 4, 6])):
            k = rng.randrange(len(part))
            part[k : k + 1] = rng.choice([[], [rng.choice(VOCAB)], [part[k], rng.choice(VOCAB)]])
            part = part or ["x"]
        p = rng.randint(0, len(w))
        docs.append((d, " ".join(w[:p] + part + w[p:])))
    docs += [(900, None), (901, ""), (902, items[5][1].replace(" ", "; ").upper()), (902, items[6][1])]
    truth = {(d, i) for d, t in docs for i, x in items if t and brute_leak(words(t), words(x))}
    dd = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    ii = spark.createDataFrame([*items, (77, None), (78, "")], "item_id long, text string")
    run = lambda **k: sorted((r.doc_id, r.item_id) for r in leakage.leaks(dd, ii, "doc_id", "text", "item_id", "text", **k).collect())
    assert run() == sorted(truth) and truth
    assert run(block_words=40) == sorted(truth)  # the items in blocks
    assert leakage.leaks(dd.limit(0), ii, "doc_id", "text", "item_id", "text").count() == 0
    assert leakage.leaks(dd, ii.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_leaks_across_line_ends():
    item = "one two three second hand violin costs eleven pages near the old mill today"
    index = leakage.Index([(1, item)])
    assert leakage.scan(index, [item.replace("three", "th-\nree").replace("second hand", "second-\nhand").replace("vi", "v­i")]) == [(0, 1, 1.0)]


def test_hamming_blocks_guarantee_the_radius():
    """Each window of an item with one word changed, left out or added comes out of the lookup."""
    rng = random.Random(1)
    index = leakage.Index([(i, text(rng, 60)) for i in range(20)])
    n = leakage.WINDOW
    for k, at in enumerate(index.at):
        own = index.words[at : at + n].tolist()
        e = rng.randrange(n)
        other = [rng.randrange(index.unknown + 1)]
        for changed in (own[:e] + other + own[e + 1 :], own[:e] + own[e + 1 :] + other, (own[:e] + other + own[e:])[:n]):
            ids = np.array(changed, np.int32)
            prints, where = index.prints(ids, np.array([0, n]))
            assert len(where) == 1 and k in index.lookup(prints)[1]


def test_coverage_merges_intervals():
    e = "one two three four five six one".split()
    p = cross_split.Passages([e, "two three four".split()])
    hits = p.scan("six one two three x one five".split())
    assert p.coverage(0, hits) == (6, 2, 3)  # all but four; before it and after it; one two three
    assert p.coverage(1, hits) == (2, 1, 0)
    assert p.coverage(0, p.scan([])) == (0, 0, 0) and not cross_split.Passages([]).scan(["a"])[1]
