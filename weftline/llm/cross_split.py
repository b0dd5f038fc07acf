"""The same or nearly the same records across splits: sharded Aho-Corasick automata over evaluation passages.

A record is a context with a question. An evaluation record overlaps a training record if their contexts are nearly
the same and their questions are (``words.near_same``: four fifths of the words of the longer one, in any order). Both
are found in the same way, contexts first, questions within linked contexts:

1. Shards. Equal texts are taken once. An evaluation text goes to the shards of its phrases (``phrases``: nearly same
   texts share one, in whatever order their words stand), a training text to those of its own; the two meet if they
   share a shard. This is an equi join on hashes, which Spark may cut at any hot key; no group is gathered.
2. Automata. What meets is sorted by evaluation text and streamed. For each batch an Aho-Corasick automaton is built
   over the passages of its evaluation texts, normalised to lower-case words with single blanks: their words and their
   runs of ``RUN`` words. It scans each normalised training text of the batch once, whole.
3. Coverage. Each match marks an interval of the evaluation text: a word the next occurrence that isn't covered yet, a
   run all its words. Merged intervals give how many words of the evaluation text are covered, in how many stretches,
   and how many of them by runs that stand in the training text as they are. Covered words, in any order, decide whether two
   texts are nearly the same, exactly; the coverage of each evaluation record comes out with the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .phrases import phrases, rarity
from .words import NEAR, Hashes, words

#: Words of a phrase for contexts, and for questions within linked contexts; words of a run.
CONTEXT_PHRASE, QUESTION_PHRASE, RUN = 4, 2, 3


class Passages:
    """An automaton over the passages of evaluation texts, given as lists of words."""

    def __init__(self, texts: list[list[str]]):
        ids: dict[str, int] = {}
        runs: dict[str, int] = {}
        self.of: list[tuple[np.ndarray, np.ndarray, list[int]]] = []
        for w in texts:
            seen: dict[str, int] = {}
            at, nth = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
            for p, x in enumerate(w):
                at[p] = ids.setdefault(x, len(ids))
                nth[p] = n = seen.get(x, 0)
                seen[x] = n + 1
            mine = [runs.setdefault(" ".join(w[p : p + RUN]), len(runs)) for p in range(len(w) - RUN + 1)]
            self.of.append((at, nth, mine))
        self.n = len(ids)
        self.automaton = ahocorasick.Automaton()
        for x, i in ids.items():
            self.automaton.add_word(f" {x} ", i)
        for run, i in runs.items():
            self.automaton.add_word(f" {run} ", self.n + i)
        if self.n:
            self.automaton.make_automaton()

    def scan(self, text: list[str]) -> tuple[np.ndarray, set[int]]:
        """How often each word of the passages stands in a text, and which of their runs do."""
        hits = np.fromiter((i for _, i in self.automaton.iter(f" {' '.join(text)} ")), np.int64) if self.n else np.zeros(0, np.int64)
        return np.bincount(hits[hits < self.n], minlength=self.n), set((hits[hits >= self.n] - self.n).tolist())

    def covered(self, k: int, count: np.ndarray) -> np.ndarray:
        """Which words of the k-th evaluation text a scanned text covers."""
        at, nth, _ = self.of[k]
        return count[at] > nth

    def coverage(self, k: int, scanned: tuple[np.ndarray, set[int]]) -> tuple[int, int, int]:
        """(covered, stretches, verbatim): words of the k-th evaluation text that the scanned text covers, in how many
        merged intervals, and how many by runs."""
        covered, verbatim = self.covered(k, scanned[0]), np.zeros(len(self.of[k][0]), bool)
        for p, run in enumerate(self.of[k][2]):
            if run in scanned[1]:
                verbatim[p : p + RUN] = True
        return int(covered.sum()), int((covered[1:] & ~covered[:-1]).sum() + covered[:1].sum()), int(verbatim.sum())


_COVER = "n_e int, n_t int, covered int, stretches int, verbatim int"


def _scan(key_e: str, key_t: str, keep: list[str], share: float):
    """Candidates (*keep, key_e, key_t, a, b) with evaluation text a and training text b -> those nearly the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            e, t = pdf[key_e].tolist(), pdf[key_t].tolist()
            first = {k: i for i, k in reversed(list(enumerate(e)))}
            held = {k: words(pdf["a"].iat[i]) for k, i in first.items()}
            order = {k: i for i, k in enumerate(held)}
            passages = Passages(list(held.values()))
            scanned: dict = {}
            rows, at = [], []
            for i, (x, y) in enumerate(zip(e, t)):
                if y not in scanned:
                    w = words(pdf["b"].iat[i])
                    scanned[y] = (len(w), passages.scan(w))
                n_t, hits = scanned[y]
                n_e = len(held[x])
                if not n_e or not n_t or min(n_e, n_t) < share * max(n_e, n_t) - 1e-9:
                    continue
                if passages.covered(order[x], hits[0]).sum() >= share * max(n_e, n_t) - 1e-9:
                    rows.append((n_e, n_t, *passages.coverage(order[x], hits)))
                    at.append(i)
            out = pdf.iloc[at][keep].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(rows, columns=["n_e", "n_t", "covered", "stretches", "verbatim"], dtype="int32")], axis=1)

    return run


def _keyed(texts: DataFrame, keep: list[str], counts, phrase: int, share: float) -> DataFrame:
    """(*keep, key): a row for each phrase of the column text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, held = Hashes(), counts.value
        for pdf in batches:
            found = [phrases(words(t), held, hashes, phrase, share) for t in pdf["text"]]
            n = np.fromiter(map(len, found), np.int64, len(found))
            out = pdf[keep].iloc[np.repeat(np.arange(len(pdf)), n)].reset_index(drop=True)
            yield out.assign(key=np.fromiter((x for f in found for x in f), np.int64, int(n.sum())))

    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    return texts.select(*keep, "text").mapInPandas(run, f"{schema}, key long")


def _rows(examples: DataFrame, id_column: str, split: str, context: str, question: str, train: str) -> DataFrame:
    side: Column = F.lower(F.regexp_replace(F.col(split), r"(?U)^\s+|\s+$", ""))
    rows = examples.select(F.col(id_column).cast("long").alias("id"), side.alias("side"), F.col(context).alias("context"), F.col(question).alias("question"))
    rows = rows.where("id is not null and side is not null and side != '' and context is not null and question is not null")
    return rows.select("id", "side", (F.col("side") == train.lower()).alias("train"), F.xxhash64("context").alias("ck"), F.xxhash64("question").alias("qk"), "context", "question")


def context_links(contexts: DataFrame, counts, share: float = NEAR) -> DataFrame:
    """(ck_e, ck_t, coverage columns) of evaluation contexts and training contexts that are nearly the same; a context
    on both sides is linked with itself. ``contexts`` has (ck, text, train, held)."""
    keyed = materialize(_keyed(contexts, ["ck", "train", "held"], counts, CONTEXT_PHRASE, share), "phrases")
    held = keyed.where("held").select("key", F.col("ck").alias("ck_e"))
    ours = keyed.where("train").select("key", F.col("ck").alias("ck_t"))
    pairs = held.join(ours, "key").select("ck_e", "ck_t").distinct()
    texts = contexts.select("ck", "text")
    met = pairs.join(texts.toDF("ck_t", "b"), "ck_t").join(texts.toDF("ck_e", "a"), "ck_e").sortWithinPartitions("ck_e")
    return met.mapInPandas(_scan("ck_e", "ck_t", ["ck_e", "ck_t"], share), f"ck_e long, ck_t long, {_COVER}")


def cross_split_links(examples: DataFrame, id_column: str = "example_id", split: str = "split", context: str = "context", question: str = "question", train: str = "train", share: float = NEAR) -> DataFrame:
    """Rows (ck_e, qk_e, ck_t, qk_t, coverage, verbatim, stretches): distinct evaluation records and the distinct
    training records they overlap with, by the 64-bit hashes of their contexts and questions.

    coverage is the share of the evaluation record's words, context and question together, that the training record
    has, verbatim the share within runs that stand there as they are, stretches the merged intervals. Copies are not
    expanded. Same cases as ``cross_split_pairs``. Runs jobs when called.
    """
    spark = examples.sparkSession
    rows = _rows(examples, id_column, split, context, question, train)
    contexts = rows.groupBy("ck").agg(F.first("context").alias("text"), F.max("train").alias("train"), F.max(~F.col("train")).alias("held"))
    contexts = materialize(contexts, "contexts")
    counts = spark.sparkContext.broadcast(rarity(contexts.select("text").unionByName(rows.select(F.col("question").alias("text")))))  # fixed size
    links = materialize(context_links(contexts, counts, share), "links")

    linked = links.select(F.col("ck_e").alias("ck")).union(links.select("ck_t")).distinct()
    asked = rows.select("ck", "qk", "train", "question").join(linked, "ck", "left_semi").groupBy("ck", "qk", "train").agg(F.first("question").alias("text"))
    asked = materialize(asked, "questions")
    keyed = materialize(_keyed(asked, ["ck", "qk", "train"], counts, QUESTION_PHRASE, share), "phrases")
    held = keyed.where("not train").select(F.col("ck").alias("ck_e"), F.col("qk").alias("qk_e"), "key")
    ours = keyed.where("train").select(F.col("ck").alias("ck_t"), F.col("qk").alias("qk_t"), "key").join(links.select("ck_e", "ck_t"), "ck_t")
    # the key holds the context too, so the questions of a hot context are spread by their phrases
    pairs = held.join(ours, ["ck_e", "key"]).select("ck_e", "qk_e", "ck_t", "qk_t").distinct()
    texts = asked.groupBy("qk").agg(F.first("text").alias("text"))
    met = pairs.join(texts.toDF("qk_t", "b"), "qk_t").join(texts.toDF("qk_e", "a"), "qk_e").sortWithinPartitions("qk_e")
    found = met.mapInPandas(_scan("qk_e", "qk_t", ["ck_e", "qk_e", "ck_t", "qk_t"], share), f"ck_e long, qk_e long, ck_t long, qk_t long, {_COVER}")
    c = links.select("ck_e", "ck_t", *[F.col(x).alias(f"c_{x}") for x in ("n_e", "covered", "stretches", "verbatim")])
    both = found.join(c, ["ck_e", "ck_t"])
    n = F.col("n_e") + F.col("c_n_e")
    return materialize(both.select(
        "ck_e", "qk_e", "ck_t", "qk_t", ((F.col("covered") + F.col("c_covered")) / n).alias("coverage"), ((F.col("verbatim") + F.col("c_verbatim")) / n).alias("verbatim"), (F.col("stretches") + F.col("c_stretches")).alias("stretches")
    ), "overlaps")


def cross_split_pairs(examples: DataFrame, id_column: str = "example_id", split: str = "split", context: str = "context", question: str = "question", train: str = "train", share: float = NEAR) -> DataFrame:
    """Rows (train_id, held_id, held_split) of records that overlap, one in the training split, one in another; of
    copies all pairs, which ``cross_split_coverage`` doesn't expand.

    Splits are compared without regard to case and blanks around them; a row without a split is on neither side. Null
    and blank contexts or questions, and those without any letter or digit, overlap with nothing. Rows that repeat an
    id count once for each split. Empty tables give no rows. Other columns are ignored.
    """
    links = cross_split_links(examples, id_column, split, context, question, train, share).select("ck_e", "qk_e", "ck_t", "qk_t")
    ids = _rows(examples, id_column, split, context, question, train).select("id", "side", "train", "ck", "qk").distinct()
    train_ids = ids.where("train").select(F.col("ck").alias("ck_t"), F.col("qk").alias("qk_t"), F.col("id").alias("train_id"))
    held_ids = ids.where("not train").select(F.col("ck").alias("ck_e"), F.col("qk").alias("qk_e"), F.col("id").alias("held_id"), F.col("side").alias("held_split"))
    return links.join(held_ids, ["ck_e", "qk_e"]).join(train_ids, ["ck_t", "qk_t"]).select("train_id", "held_id", "held_split")


def cross_split_coverage(examples: DataFrame, id_column: str = "example_id", split: str = "split", context: str = "context", question: str = "question", train: str = "train", share: float = NEAR) -> DataFrame:
    """One row (id, split, rep, train_rep, links, coverage, verbatim, stretches) for each evaluation record that
    overlaps with the training split.

    rep is the least id of records with the same context and question in an evaluation split, links how many different
    training records overlap, train_rep the least id of the one that covers most of it, of equals the one of least
    id; coverage, verbatim and stretches are of that one. Same cases as ``cross_split_pairs``.
    """
    links = cross_split_links(examples, id_column, split, context, question, train, share)
    ids = _rows(examples, id_column, split, context, question, train).select("id", "side", "train", "ck", "qk").distinct()
    reps = ids.groupBy("ck", "qk", "train").agg(F.min("id").alias("rep"))
    ours = reps.where("train").select(F.col("ck").alias("ck_t"), F.col("qk").alias("qk_t"), F.col("rep").alias("train_rep"))
    theirs = reps.where("not train").select(F.col("ck").alias("ck_e"), F.col("qk").alias("qk_e"), "rep")
    best = F.max_by(F.struct("train_rep", "coverage", "verbatim", "stretches"), F.struct("coverage", "verbatim", -F.col("train_rep"))).alias("best")
    per = links.join(ours, ["ck_t", "qk_t"]).groupBy("ck_e", "qk_e").agg(F.count("*").alias("links"), best).join(theirs, ["ck_e", "qk_e"])
    held = ids.where("not train").select("id", F.col("side").alias("split"), F.col("ck").alias("ck_e"), F.col("qk").alias("qk_e"))
    return held.join(per, ["ck_e", "qk_e"]).select("id", "split", "rep", "best.train_rep", "links", "best.coverage", "best.verbatim", "best.stretches")


def overlap_report(examples: DataFrame, covered: DataFrame, source: Column, id_column: str = "example_id", split: str = "split") -> DataFrame:
    """Rows (split, source, records, overlapping, coverage): how many records of each evaluation split and source also
    stand in the training split, by ``cross_split_coverage``, and how much of them is covered in the mean; sources
    without overlap are left out."""
    side = F.lower(F.regexp_replace(F.col(split), r"(?U)^\s+|\s+$", ""))
    hit = covered.select("id", "split", "coverage")
    all_ = examples.select(F.col(id_column).cast("long").alias("id"), side.alias("split"), source.alias("source"))
    out = all_.join(hit, ["id", "split"], "left").groupBy("split", "source").agg(F.count("*").alias("records"), F.count("coverage").alias("overlapping"), F.round(F.avg("coverage"), 4).alias("coverage"))
    return out.where("overlapping > 0")
