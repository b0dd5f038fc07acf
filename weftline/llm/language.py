"""Language of documents and of the passages in them: nearest centroids of TF-IDF character n-grams.

Training takes a bounded sample of labelled rows (``SAMPLE`` segments for each label). Labels are noisy. A
label, the rarest first, whose segments are about as near to the other labels' centroids as those labels' own segments
are names no language of these texts and is dropped. Of the others a segment stays if, of one centroid for each label,
the nearest without the segment itself is that of its label; a label must keep half of its segments. What stays is
clustered into ``CLUSTERS`` centroids for each language by spherical k-means. A segment whose cosine with its nearest
centroid is under that centroid's bound (a share of what its own training segments reach) is rejected.

A segment is a sentence or line. Its vector is the sum of its words' vectors; a word's vector holds the n-grams of two
to four characters of the word with a blank on either side, hashed and weighted by inverse document frequency. Scores
of words against all centroids are therefore added up to those of segments, and each distinct word is scored once for
a batch. The length of a segment's vector doesn't add up; it is computed from the counts of all its n-grams.

In documents whose segments disagree, the sequence of languages is the one of highest total score with a price for
each change (Viterbi), so a name or a doubtful short line doesn't make a passage. Lines of under ``LEAST_WORDS`` words
say little: those in a row are pooled, and what is still shorter goes with the passage around it, if the words are of
its language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import LATIN, raw_words

BITS, GRAMS = 16, (2, 3, 4)
SAMPLE, MIN_SUPPORT, CLUSTERS = 500, 12, 3
LEAST_WORDS, RUNNING, CHANGE, REJECT, REDUNDANT = 4, 12, 1.6, 0.45, 0.9

# Codes of ISO 639 (two letters; three letters, bibliographic and terminological) and English names.
LANGUAGES = """
ar ara arabic|bg bul bulgarian|ca cat catalan|cs ces cze czech|da dan danish|de deu ger german|el ell gre greek
en eng english|es spa spanish castilian|et est estonian|fa fas per persian|fi fin finnish|fr fra fre french
he heb hebrew|hi hin hindi|hr hrv croatian|hu hun hungarian|id ind indonesian|it ita italian|ja jpn japanese
ko kor korean|lt lit lithuanian|lv lav latvian|nl nld dut dutch flemish|no nor norwegian|pl pol polish
pt por portuguese|ro ron rum romanian|ru rus russian|sk slk slo slovak|sl slv slovenian|sr srp serbian
sv swe swedish|th tha thai|tr tur turkish|uk ukr ukrainian|vi vie vietnamese|zh zho chi chinese
"""
CODES = {form: x.split()[0] for x in LANGUAGES.replace("\n", "|").split("|") if x.strip() for form in x.split()}


def language_code(label: Column) -> Column:
    """The two-letter code that a label names in a common form (two or three letters, with a region, English name, any
    case, blanks around it); null for null, blank, placeholders and all else."""
    first = F.regexp_extract(F.lower(label), r"^[\s]*([a-z]+)(?:[-_][a-z0-9]+)*[\s]*$", 1)
    return F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])[first]


_SEGMENT = re.compile(r"[^\n.!?…]+(?:[.!?…]+(?![\s.!?…]|$)[^\n.!?…]*)*[.!?…]*")


def segments(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences and lines of a text."""
    return [m.span() for m in _SEGMENT.finditer(text)]


_QUOTED = re.compile(r"[«“„\"]([^«»“”„\"\n]{1,60})[»”“\"]")


def _without_quotes(text: str) -> str:
    """The text with short quoted phrases blanked, for these are no text of the language around them."""
    return _QUOTED.sub(lambda m: " " * len(m[0]), text)


def _split(text: str, spans: list[tuple[int, int]]) -> list[list]:
    """The words of each segment, in the forms of ``raw_words``."""
    try:
        b = text.encode("latin-1").translate(LATIN)
    except UnicodeEncodeError:
        return [raw_words(text[x:y]) for x, y in spans]
    return [b[x:y].split() for x, y in spans]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of words, a blank before each and after the last, and where each word's blank is."""
    text = " " + " ".join(words) + " "
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    blanks = np.flatnonzero(codes == 32)
    return codes, blanks


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of the words."""
    codes, blanks = _codes(words)
    word = np.searchsorted(blanks, np.arange(len(codes)), "right") - 1
    inner = codes != 32
    of, bucket = [], []
    for n in GRAMS:
        if len(codes) < n:
            continue
        h = np.zeros(len(codes) - n + 1, np.uint64)
        crosses = np.zeros(len(h), bool)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(h) + k] + np.uint64(1)
            if 0 < k < n - 1:
                crosses |= ~inner[k : len(h) + k]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        ok = ~crosses
        of.append(word[: len(h)][ok])
        bucket.append((h[ok] >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(of), np.concatenate(bucket)


@dataclass
class Model:
    languages: list[str]
    of: np.ndarray  # the language of each centroid
    table: np.ndarray  # bucket x centroids: what an n-gram adds to the products with all centroids
    idf: np.ndarray  # bucket: its weight
    bound: np.ndarray  # least cosine for each centroid


_LETTER = re.compile(r"[^\W\d_]")


class Scorer:
    """Scores segments, and remembers the rows and n-grams of words it has seen (``limit`` at most)."""

    def __init__(self, model: Model, limit: int = 150_000):
        self.model, self.limit = model, limit
        self._forget()

    def _forget(self) -> None:
        self.ids: dict = {}
        self.rows = np.zeros((0, self.model.table.shape[1]), np.float32)
        self.buckets = np.zeros(0, np.uint32)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def word_ids(self, flat: list) -> np.ndarray:
        new = set(flat).difference(self.ids)
        if new:
            if len(self.ids) + len(new) > self.limit and self.ids:
                self._forget()
                new = set(flat)
            new = list(new)
            for w in new:
                self.ids[w] = len(self.ids)
            for lo in range(0, len(new), 20_000):
                self._learn([w.decode("latin-1") if isinstance(w, bytes) else w for w in new[lo : lo + 20_000]])
        return np.fromiter(map(self.ids.__getitem__, flat), np.int32, len(flat))

    def _learn(self, words: list[str]) -> None:
        of, bucket = grams(words)
        digits = np.array([w.isdigit() for w in words])  # they say nothing of a language
        keep = ~digits[of]
        of, bucket = of[keep], bucket[keep]
        order = np.argsort(of, kind="stable")
        of, bucket = of[order], bucket[order]
        size = np.bincount(of, minlength=len(words))
        rows = np.zeros((len(words), self.rows.shape[1]), np.float32)
        some = np.flatnonzero(size)
        if len(some):
            rows[some] = np.add.reduceat(self.model.table[bucket], (np.cumsum(size) - size)[some], axis=0)
        self.first = np.concatenate([self.first, len(self.buckets) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.buckets = np.concatenate([self.buckets, bucket.astype(np.uint32)])
        self.rows = np.concatenate([self.rows, rows])

    def _lengths(self, ids: np.ndarray, segment: np.ndarray, n: int) -> np.ndarray:
        """The lengths of the segments' vectors, from the words and the segments they are in (under 65,536)."""
        size = self.size[ids]
        at = np.repeat(self.first[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        codes = np.sort(np.repeat(segment.astype(np.uint32) << np.uint32(BITS), size) | self.buckets[at])
        if not len(codes):
            return np.zeros(n)
        begin = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        code, count = codes[begin], np.diff(np.append(begin, len(codes)))
        return np.sqrt(np.bincount(code >> np.uint32(BITS), (count * self.model.idf[code & np.uint32((1 << BITS) - 1)]) ** 2, minlength=n))

    def cosines(self, words: list[list]) -> np.ndarray:
        """segments x centroids"""
        counts = np.array([len(w) for w in words])
        out = np.zeros((len(words), len(self.model.of)), np.float32)
        flat = [x for w in words for x in w]
        if not flat:
            return out
        ids = self.word_ids(flat)
        some = np.flatnonzero(counts > 0)
        starts = (np.cumsum(counts) - counts)[some]
        for lo in range(0, len(some), 8192):  # blocks keep what is gathered small
            hi = min(len(some), lo + 8192)
            a, b = starts[lo], starts[hi] if hi < len(some) else len(ids)
            total = np.add.reduceat(self.rows[ids[a:b]], starts[lo:hi] - a, axis=0)
            length = self._lengths(ids[a:b], np.repeat(np.arange(hi - lo), counts[some[lo:hi]]), hi - lo)
            out[some[lo:hi]] = total / np.maximum(length, 1e-6)[:, None]
        return out

    def segment_scores(self, words: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """For each segment and language the best cosine, and whether the segment is rejected."""
        cos = self.cosines(words)
        m = self.model
        best = np.stack([cos[:, m.of == i].max(1) for i in range(len(m.languages))], axis=1)
        nearest = cos.argmax(1)
        return best, cos[np.arange(len(cos)), nearest] < m.bound[nearest]


def _path(best: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The sequence of languages of highest total score with a price for each change."""
    score = (best - best.max(1, keepdims=True)) * weight[:, None]
    n, k = score.shape
    total, back = score[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        top = int(total.argmax())
        change = total[top] - CHANGE
        back[i] = np.where(total >= change, np.arange(k), top)
        total = np.maximum(total, change) + score[i]
    path = np.zeros(n, np.int64)
    path[-1] = total.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


Passage = tuple[int, int, str, float, int]


def _pooled(span: list[tuple[int, int]], words: list[list]) -> tuple[list[tuple[int, int]], list[list]]:
    """Segments with those of under LEAST_WORDS words that stand in a row put together until they have as many."""
    spans, out, open_ = [], [], False
    for x, w in zip(span, words):
        if not w:
            continue
        short = len(w) < LEAST_WORDS
        if short and open_:
            spans[-1], out[-1] = (spans[-1][0], x[1]), out[-1] + w
        else:
            spans.append(x)
            out.append(w)
        open_ = short and len(out[-1]) < LEAST_WORDS
    return spans, out


def passages(scorer: Scorer, texts: list[str | None]) -> list[list[Passage]]:
    """For each text its passages (start, end, language, confidence, words): what stands between changes of language.
    words counts those of the passage's own segments, and of shorter ones within it whose words are of its language."""
    spans, split, number = [], [], []
    for t in texts:
        s = segments(t) if t else []
        w = _split(_without_quotes(t) if '"' in t or "«" in t or "“" in t or "„" in t else t, s) if s else []
        if w and min(map(len, w)) < LEAST_WORDS:
            s, w = _pooled(s, w)
        spans += s
        split += w
        number.append(len(s))
    out: list[list[Passage]] = [[] for _ in texts]
    if not split:
        return out
    count = np.fromiter(map(len, split), np.int64, len(split))
    best, rejected = scorer.segment_scores(split)
    doc = np.repeat(np.arange(len(texts)), number)
    own = best.argmax(1)
    long = (count >= LEAST_WORDS) & ~rejected
    # a text of nothing longer is taken by its short segments
    none = ~np.isin(doc, doc[long])
    use = np.flatnonzero(long | none & ~rejected & (count > 0))
    if not len(use):
        return out
    d, n, b, lang = doc[use], count[use], best[use], own[use].copy()
    starts = np.flatnonzero(np.diff(d, prepend=-1))
    ends = np.append(starts[1:], len(d))
    mixed = np.logical_or.reduceat(lang != np.repeat(lang[starts], ends - starts), starts)
    for lo, hi in zip(starts[mixed], ends[mixed]):
        lang[lo:hi] = _path(b[lo:hi], n[lo:hi])
    # a passage begins with each document and change of language
    begin = np.flatnonzero((np.diff(d, prepend=-1) != 0) | (np.diff(lang, prepend=-1) != 0))
    words = np.add.reduceat(n, begin)
    # short segments within a document go with the passage before them, else the one after, if of its language
    short = np.flatnonzero((count > 0) & (count < LEAST_WORDS) & ~rejected & ~none)
    if len(short):
        at = np.searchsorted(use[begin], short, "right") - 1
        at = np.where((at < 0) | (d[begin][np.maximum(at, 0)] != doc[short]), at + 1, at)
        same = own[short] == lang[begin[at]]
        np.add.at(words, at[same], count[short[same]])
    end = np.append(begin[1:], len(d))
    mean = np.add.reduceat(b * n[:, None], begin, axis=0) / np.add.reduceat(n, begin)[:, None]
    rows = np.arange(len(begin))
    mine = mean[rows, lang[begin]]
    mean[rows, lang[begin]] = 0
    sure = np.clip(mine / np.maximum(mine + np.maximum(mean.max(1), 0), 1e-6), 0, 1)
    names = scorer.model.languages
    for i, x, y, l, c, w in zip(d[begin].tolist(), use[begin].tolist(), use[end - 1].tolist(), lang[begin].tolist(), sure.tolist(), words.tolist()):
        out[i].append((spans[x][0], spans[y][1], names[l], round(c, 4), w))
    return out


# --- training ---


def _sampler(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for label, text in zip(pdf["label"], pdf["text"]):
            for a, b in segments(text):
                if len(raw_words(text[a:b])) >= 6:
                    rows.append((label, text[a:b]))
        yield pd.DataFrame(rows, columns=["label", "segment"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` segments of each label's rows; which ones depends on their hash only."""
    labelled = docs.select(language_code(F.col(lang)).alias("label"), F.col(text).alias("text")).where("label is not null and text is not null")
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # a row a language
    if not sizes:
        raise ValueError("no labelled rows to train on")
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 2.0 * sample / n)))])
    order = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1_000_000)) / 1_000_000
    some = labelled.where(order < share[F.col("label")])
    found = some.mapInPandas(_sampler, "label string, segment string").withColumn("h", F.xxhash64("segment"))
    # a row for each label and slot: the least hash in it; slots bound what is kept, however many rows there are
    slots = found.groupBy("label", F.pmod("h", F.lit(sample)).alias("slot")).agg(F.min_by("segment", "h").alias("segment"))
    got = slots.toPandas().sort_values(["label", "slot"])
    return train(got["label"].tolist(), got["segment"].tolist(), sizes)


def train(labels: list[str], texts: list[str], sizes: dict[str, int] | None = None) -> Model:
    words = [raw_words(t) for t in texts]
    words = [[w.decode("latin-1") if isinstance(w, bytes) else w for w in x] for x in words]
    words = [[w for w in x if not w.isdigit()] for x in words]
    keep = [i for i, x in enumerate(words) if x]
    words, labels = [words[i] for i in keep], [labels[i] for i in keep]
    n = len(words)
    of_word = np.repeat(np.arange(n), [len(x) for x in words])
    of, bucket = grams([w for x in words for w in x])
    pair, tf = np.unique(of_word[of] * (1 << BITS) + bucket, return_counts=True)
    seg, gram = pair >> BITS, pair & ((1 << BITS) - 1)
    idf = np.log((1 + n) / (1 + np.bincount(gram, minlength=1 << BITS))) + 1
    value = tf * idf[gram]
    value /= np.sqrt(np.bincount(seg, value**2, minlength=n))[seg]
    names = sorted(set(labels))
    label = np.array([names.index(x) for x in labels])

    def centroids(group: np.ndarray, k: int, use: np.ndarray) -> np.ndarray:
        m = use[seg]
        c = np.bincount(group[seg[m]] * (1 << BITS) + gram[m], value[m], minlength=k << BITS).reshape(k, -1)
        return c

    def scores(c: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(seg, value * row[gram], minlength=n) for row in c], axis=1)

    # labels that name nothing of their own: the fewer rows, the sooner asked
    live = np.ones(len(names), bool)
    use = np.ones(n, bool)
    c = centroids(label, len(names), use)
    cos = scores(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9))
    typical = np.array([np.median(cos[label == i, i]) for i in range(len(names))])
    for i in sorted(range(len(names)), key=lambda i: (sizes or {}).get(names[i], int((label == i).sum()))):
        others = live & (np.arange(len(names)) != i)
        if others.any() and np.median((cos[label == i][:, others] / typical[others]).max(1)) >= REDUNDANT:
            live[i] = False
    use = live[label]
    # segments of another language than their label's
    for _ in range(4):
        c = centroids(label, len(names), use)
        norm = np.linalg.norm(c, axis=1)
        dot = scores(c)
        own = dot[np.arange(n), label]
        # without the segment itself
        cos = dot / np.maximum(norm, 1e-9)
        rest = np.sqrt(np.maximum(norm[label] ** 2 - 2 * own + 1, 1e-9))
        cos[np.arange(n), label] = np.where(use, (own - 1) / rest, own / np.maximum(norm[label], 1e-9))
        cos[:, ~live] = -1
        use = (cos.argmax(1) == label) & live[label]
        support = np.bincount(label, use, minlength=len(names))
        live &= (support >= 0.5 * np.bincount(label, minlength=len(names))) & (support >= min(MIN_SUPPORT, support.max()))
        use &= live[label]
    languages = [x for x, ok in zip(names, live) if ok]
    table, owner = [], []
    rng = np.random.default_rng(5)
    for i in np.flatnonzero(live):
        mine = np.flatnonzero(use & (label == i))
        k = max(1, min(CLUSTERS, len(mine) // MIN_SUPPORT))
        group = np.zeros(n, np.int64)
        group[mine] = rng.integers(0, k, len(mine))
        only = np.zeros(n, bool)
        only[mine] = True
        for _ in range(8):
            c = centroids(group, k, only)
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
            group[mine] = scores(c)[mine].argmax(1)
        c = centroids(group, k, only)
        filled = np.linalg.norm(c, axis=1) > 0
        c = c[filled] / np.linalg.norm(c[filled], axis=1, keepdims=True)
        table.append(c)
        owner += [languages.index(names[i])] * len(c)
    c = np.concatenate(table)
    of = np.array(owner)
    cos = scores(c)
    nearest = cos.argmax(1)
    reach = cos[np.arange(n), nearest]
    bound = np.array([REJECT * np.median(reach[use & (nearest == j)]) if (use & (nearest == j)).any() else 1.0 for j in range(len(c))])
    return Model(languages, of, np.ascontiguousarray((c * idf).T, np.float32), idf.astype(np.float32), bound.astype(np.float32))


# --- on tables ---

_PASSAGE = "start int, end int, lang string, confidence double, words int"


def detect(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row (doc_id, label, lang, confidence, passages) for each row of docs.

    label is the code that the delivered label names, or null; lang the language of most words, confidence the share of
    its cosine in that of the two best languages, passages the text's passages in order. Null and empty texts, and
    those of which nothing comes near a centroid, have a null lang and no passages. Repeated
    rows each have a row. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: buckets x centroids
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), language_code(F.col(lang)).alias("label"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo in range(0, len(texts), 1000):
                found = passages(scorer, [t if isinstance(t, str) else None for t in texts[lo : lo + 1000]])
                best = [_main(p) for p in found]
                part = pdf.iloc[lo : lo + 1000]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(), "label": part["label"].to_numpy(), "lang": [b[0] for b in best], "confidence": [b[1] for b in best],
                    "passages": [[dict(zip(("start", "end", "lang", "confidence", "words"), x)) for x in p] for p in found],
                })

    return rows.mapInPandas(run, f"doc_id long, label string, lang string, confidence double, passages array<struct<{_PASSAGE.replace(' ', ':').replace(',:', ',')}>>")


def _main(found: list[tuple[int, int, str, float, int]]) -> tuple[str | None, float | None]:
    if not found:
        return None, None
    total: dict[str, int] = {}
    for _, _, x, _, n in found:
        total[x] = total.get(x, 0) + n
    lang = max(sorted(total), key=total.__getitem__)
    return lang, round(sum(c * n for _, _, x, c, n in found if x == lang) / total[lang], 4)


def written(detected: DataFrame, running: int = RUNNING) -> DataFrame:
    """(doc_id, label, langs): the languages in which a document has a passage of ``running`` words at least."""
    return detected.select("doc_id", "label", F.array_distinct(F.transform(F.filter("passages", lambda p: p["words"] >= running), lambda p: p["lang"])).alias("langs"))


def mislabelled(detected: DataFrame, running: int = RUNNING) -> DataFrame:
    """(doc_id, lang) for documents without a label, with one of another language, or in several languages."""
    w = written(detected, running).where((F.size("langs") > 1) | F.col("label").isNull() | ~F.array_contains("langs", F.col("label")))
    return w.select("doc_id", F.explode("langs").alias("lang")).distinct()
