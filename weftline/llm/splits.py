"""Splits that keep related records together: hash-to-min components, weighted rendezvous hashing.

Records are related if they share a key: the prompt they name, the prompt their question belongs to, and whatever other
columns are given. A record's keys, in canonical form, are linked with each other, so a
component holds all records of one author, source or entity, also where two of them are tied by one record only.

Each component then gets the split of highest weight / -ln(h), h a hash of component and split in (0, 1): rendezvous
hashing, by which adding a split moves only what it wins. Components differ in size and one may hold a third of all
rows, so equal weights would miss the shares. The weights of each category are therefore fitted: in a few passes over
the components, each with one aggregation, the weight of a split that got too much falls and the other way round; the
best pass counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release
from .components import hash_to_min

PASSES = 14


def canonical_id(column: Column) -> Column:
    """An id without regard to case, blanks, punctuation and leading zeros of its number; null for null and blank."""
    bare = F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", "")
    return F.nullif(F.regexp_replace(bare, r"(?<=\p{L})0+(?=\d)", ""), F.lit(""))


def canonical_label(column: Column) -> Column:
    """A label in lower case, with one underscore for each run of blanks and punctuation; '' for null and blank."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", ""), F.lit(""))


def related(records: DataFrame, keys: Column) -> DataFrame:
    """Rows (key, component) of keys that some record ties to another key: records are related if they share a key,
    directly or through others. A key that isn't here stands alone and is a component of its own.

    ``keys`` is an array of a record's keys, as text, nulls left out. A record's first key is linked with each other
    one; keys that stand alone in all their records need no round of ``hash_to_min``. A record without any key is
    related to none. Repeated rows count once.
    """
    rows = records.select(F.array_distinct(F.array_compact(keys)).alias("k")).where("size(k) > 1")
    links = rows.select(F.get("k", 0).alias("a"), F.explode(F.slice("k", F.lit(2), F.size("k") - 1)).alias("b")).distinct()
    return hash_to_min(links).toDF("key", "component")


def prompt_keys(id_column: str = "system_prompt_id", question_id: str = "question_id", also: tuple[str, ...] = ()) -> Column:
    """The keys of a row: the prompt that ``id_column`` names, the prompt whose question ``question_id`` says it is (what
    stands before the last _q), in canonical form, and the values of the columns ``also``, by their hash. Null without
    any of them in its place."""
    told = F.regexp_extract(question_id, r"^(.*)_[qQ]\d+\s*$", 1)
    more = [F.when(F.col(c).isNotNull() & (F.btrim(F.col(c).cast("string")) != ""), F.concat(F.lit(f"{i}:"), F.sha2(F.col(c).cast("string"), 256))) for i, c in enumerate(also)]
    return F.array(*[F.concat(F.lit("p:"), canonical_id(x)) for x in (F.col(id_column), told)], *more)


def key_components(examples: DataFrame, keys: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, *by, n, component): how many rows have each first key, and its component. Rows without a key have
    null for both."""
    named = examples.select(F.array_distinct(F.array_compact(keys)).alias("k"), *[F.col(c) for c in by])
    named = materialize(named.groupBy("k", *by).agg(F.count("*").alias("n")), "named")
    found = related(named, F.col("k"))
    per = named.select(F.get("k", 0).alias("key"), *by, "n").groupBy("key", *by).agg(F.sum("n").alias("n"))
    return per.join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))


def split_prompts(examples: DataFrame, prompts: DataFrame, id_column: str = "system_prompt_id", question_id: str = "question_id", split: str = "split", prompt_id: str = "id") -> DataFrame:
    """Rows (system_prompt_id), as written in ``prompts``, of prompts whose rows stand in more than one split.

    A row's prompt is what ``id_column`` names, else what ``question_id`` tells. Only components of related prompts that
    stand in several splits are looked into. Splits differ by more than case and blanks; null and blank ones are none. A
    prompt that ``prompts`` doesn't have is written as its least spelling. Rows that name no prompt belong to none. Empty
    tables give no rows.
    """
    side = canonical_label(F.col(split)).alias("side")
    spelling = F.coalesce(F.nullif(F.regexp_replace(F.col(id_column), r"(?U)^\s+|\s+$", ""), F.lit("")), F.nullif(F.regexp_extract(F.col(question_id), r"^(.*)_[qQ]\d+\s*$", 1), F.lit(""))).alias("spelling")
    rows = examples.select(F.col(id_column).alias("raw"), F.col(question_id).alias("qid"), side, spelling)
    parts = materialize(key_components(rows, prompt_keys("raw", "qid"), ("side", "spelling")).where("component is not null and side != ''"), "parts")
    torn = parts.groupBy("component").agg(F.min("side").alias("least"), F.max("side").alias("most")).where("least < most").select("component")
    broken = parts.join(torn, "component", "left_semi").groupBy("key").agg(F.min("side").alias("least"), F.max("side").alias("most"), F.min("spelling").alias("spelling")).where("least < most")
    broken = materialize(broken.select(F.substring("key", 3, 1 << 30).alias("canonical"), "spelling"), "broken")
    # of all prompts only these are grouped and joined
    named = prompts.withColumn("canonical", canonical_id(F.col(prompt_id))).join(broken.select("canonical"), "canonical", "left_semi")
    return broken.join(written_ids(named, prompt_id), "canonical", "left").select(F.coalesce("as_written", "spelling").alias("system_prompt_id"))


def written_ids(prompts: DataFrame, prompt_id: str = "id") -> DataFrame:
    """(canonical, as_written): how the table of prompts writes each id, the least of several ways."""
    ids = prompts.select(canonical_id(F.col(prompt_id)).alias("canonical"), F.col(prompt_id).alias("as_written"))
    return ids.where("canonical is not null").groupBy("canonical").agg(F.min("as_written").alias("as_written"))


def row_canonical(id_column: str = "system_prompt_id", question_id: str = "question_id") -> Column:
    """The canonical id of a row's prompt: of ``id_column``, else of what ``question_id`` tells; null of neither."""
    return F.coalesce(canonical_id(F.col(id_column)), canonical_id(F.regexp_extract(question_id, r"^(.*)_[qQ]\d+\s*$", 1)))


def rendezvous(components: DataFrame, shares: dict[str, float], seed: int = 0, passes: int = PASSES) -> DataFrame:
    """``components`` (component, category, n) with the column ``split``.

    n is how many rows a component has. Shares are of rows, over all and within each category; they are divided by
    their sum. Ties go to the split whose name comes last. Each category has weights of its own, kept as rows of a
    table, however many categories there are.
    """
    total = sum(shares.values())
    names = sorted(s for s in shares if shares[s] > 0)
    want = [shares[s] / total for s in names]
    fraction = [(F.pmod(F.xxhash64("component", F.lit(s), F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53) for s in names]
    base = components.select("component", "category", "n", F.coalesce("category", F.lit("")).alias("g"), F.array(*[-F.log(h) for h in fraction]).alias("e"))
    base = materialize(base, "components")
    if not names:
        return base.select("component", "category", "n", F.lit(None).cast("string").alias("split"))

    def chosen(weights: DataFrame, column: str) -> DataFrame:
        scores = F.zip_with(column, "e", lambda w, e: w / e)
        at = F.array_max(F.transform(scores, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))["i"]
        return base.join(weights.select("g", column), "g").select("component", "category", "n", "g", at.alias("at"))

    wanted = F.array(*[F.lit(x) for x in want])
    weights = materialize(base.groupBy("g").agg(F.count("*").alias("c")).select("g", wanted.alias("now"), wanted.alias("best"), F.lit(2.0).cast("double").alias("off")), "weights")
    for k in range(passes):
        sums = [F.sum(F.when(F.col("at") == i, F.col("n")).otherwise(0)) for i in range(len(names))]
        got = chosen(weights, "now").groupBy("g").agg(F.array(*sums).alias("got"), F.sum("n").alias("rows"))
        have = F.transform("got", lambda x: x / F.col("rows"))
        off = F.array_max(F.zip_with("have", wanted, lambda x, y: F.abs(x - y)))
        power = 1.0 if k < passes // 2 else 0.5
        factor = F.zip_with("have", wanted, lambda x, y: F.pow(F.least(F.lit(4.0), F.greatest(F.lit(0.25), (y + 1e-4) / (x + 1e-4))), F.lit(power)))
        raw = F.zip_with("now", factor, lambda x, y: x * y)
        after = weights.join(got.select("g", have.alias("have")), "g").withColumn("here", off).withColumn("raw", raw)
        better = F.col("here") < F.col("off")
        after = after.select(
            "g", F.transform("raw", lambda x: x / F.aggregate("raw", F.lit(0.0), lambda a, b: a + b)).alias("now"), F.when(better, F.col("now")).otherwise(F.col("best")).alias("best"), F.least("here", "off").alias("off")
        )
        before, weights = weights, materialize(after, "weights")
        release(before)
    return chosen(weights, "best").select("component", "category", "n", F.get(F.array(*[F.lit(s) for s in names]), F.col("at")).alias("split"))


def assign_splits(
    examples: DataFrame, targets: DataFrame, id_column: str = "system_prompt_id", question_id: str = "question_id", category: str = "category", seed: int = 0, also: tuple[str, ...] = ()
) -> DataFrame:
    """Rows (key, system_prompt_id, component, split, category, n): one for each first key of rows.

    Components are of ``prompt_keys``; all keys of one have its split. category is what most rows of the component say,
    the least of equals; nulls and blanks count as one category that only wins alone. n counts the rows of the key.
    system_prompt_id is the canonical id, null for a key that is no prompt. ``targets`` has (split, target_share), a row
    a split. Rows without a key form no component. Empty examples give no rows. Runs jobs when called.
    """
    shares = {r["split"]: float(r["target_share"]) for r in targets.select("split", "target_share").where("split is not null and target_share is not null").collect()}
    label = canonical_label(F.col(category)).alias("label")
    parts = materialize(key_components(examples.select(prompt_keys(id_column, question_id, also).alias("keys"), label), F.col("keys"), ("label",)).where("component is not null"), "parts")
    per = parts.groupBy("component", "label").agg(F.sum("n").alias("n"))
    most = per.groupBy("component").agg(F.sum("n").alias("n"), F.max(F.when(F.col("label") != "", F.col("n"))).alias("top"))
    named = per.where("label != ''").join(most.select("component", "top"), "component").where("n = top").groupBy("component").agg(F.min("label").alias("category"))
    sized = most.select("component", "n").join(named, "component", "left").withColumn("category", F.coalesce("category", F.lit("")))
    placed = rendezvous(sized.select("component", "category", "n"), shares, seed).select("component", "split", "category")
    keys = parts.groupBy("key", "component").agg(F.sum("n").alias("n"))
    prompt = F.when(F.startswith("key", F.lit("p:")), F.substring("key", 3, 1 << 30)).alias("system_prompt_id")
    return keys.join(placed, "component").select("key", prompt, "component", "split", "category", "n")


def assigned_rows(examples: DataFrame, assigned: DataFrame, row_id: str, id_column: str = "system_prompt_id", question_id: str = "question_id", also: tuple[str, ...] = ()) -> DataFrame:
    """Rows (row_id, system_prompt_id, split) of all examples, by what ``assign_splits`` gave with the same ``also``;
    system_prompt_id is the canonical id. Rows without a key are related to none and go to the largest split."""
    key = F.get(F.array_compact(prompt_keys(id_column, question_id, also)), 0)
    rows = examples.select(F.col(row_id).alias("row_id"), row_canonical(id_column, question_id).alias("system_prompt_id"), key.alias("key"))
    largest = assigned.groupBy("split").agg(F.sum("n").alias("n")).agg(F.max_by("split", "n").alias("largest"))
    out = rows.join(assigned.select("key", "split"), "key", "left").join(F.broadcast(largest))  # largest is one row
    return out.select(F.col("row_id").alias(row_id), "system_prompt_id", F.coalesce("split", "largest").alias("split"))
