"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. *Voters.* Lexicon families (insults, threats, vulgar words of four languages) and patterns (shouting,
   repeated marks) vote whatever the labels say. Over a bounded sample of labelled training rows each word
   and each word beginning that mostly marks labelled rows becomes a voter too, and voters on how many hits
   a text has vote both ways. A beginning replaces the words it explains. No voter is left out.
2. *Label model.* The votes have a hidden class each; every voter's accuracies in either class are estimated
   by expectation maximisation, started from the labels of the sample. What two voters share beyond the
   class, the correlation of their residuals, divides their weight, so that copies of one voter count as one.
3. *Classifier.* Logistic regression on the posterior labels, over counts of the voters' hits and of the
   words that speak most for or against. It scores whole texts; nothing else of a row is an input.

Rows that the training doesn't see at all: those whose crc32(id as text) mod 3 is 1. The bound is
``SAMPLE`` labelled rows, the first in the order of a hash of their ids; what the driver holds of them are
sparse counts, and the model is some thousand weights. Scoring reads every text once, without a shuffle.

Defined results: a null text counts as empty, and empty texts get the classifier's base rate; repeated
rows get equal scores; of rows that repeat a labelled id one is trained on, with the id's highest label;
labels of unknown rows and null labels are left out; without any toxic training row every score is 0. An
empty table gives no rows. Other columns are never looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, stage, whole_text

#: Labelled rows that the model is fitted on at most.
SAMPLE = 12_000
#: Rows that a voter's word must mark at least, and the least share of toxic rows among those, smoothed.
MIN_SUPPORT, MIN_PRECISION = 4, 0.7
#: Lengths of the word beginnings, and the number of other words in the classifier.
BEGINNINGS, OTHER_WORDS = (4, 5, 6, 7, 8), 500
#: Hits from which on the counting voters say toxic.
HITS = (1, 2, 3, 5)
PREDICT = 0.7
WORD = re.compile(r"[^\W\d_]+")
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}")
ROUNDS, STEPS, RIDGE = 50, 300, 1e-3
#: Voters whose residuals are compared at once.
BLOCK = 512
#: Beginnings of words by family: general lexicons of English, German, French and Spanish.
FAMILIES = {
    "insult": "idiot moron stupid loser clown worthless pathetic imbecile dumb fool jerk trottel dumm blöd depp versager crétin débile abruti imbécil tonto estúpid inútil payaso".split(),
    "contempt": "scum trash garbage disgust vermin filth abschaum dreck ekelhaft ordure racaille dégoût basura escoria asco".split(),
    "threat": "kill murder hate töten hasse tuer haine matar odio".split(),
    "vulgar": "shit fuck bitch bastard asshole scheiß arschloch wichser merde connard putain salope mierda puta cabrón".split(),
}
STEMS = {stem: f"#{family}" for family, stems in FAMILIES.items() for stem in stems}
STEM_LENGTHS = sorted({len(x) for x in STEMS})


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features_of(word: str) -> list[str]:
    """The word itself, its beginnings as ``beginning*``, and the families it belongs to as ``#family``."""
    families = {STEMS[word[:k]] for k in STEM_LENGTHS if word[:k] in STEMS}
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k), *sorted(families)]


def signals_of(text: str | None, words: int) -> list[str]:
    """What a text's letters and marks say, as ``!signal``."""
    text = text or ""
    shouted = len(CAPITALS.findall(text))
    return [f"!{name}" for name, holds in (("shouts", shouted * 2 > words), ("some_shouting", shouted >= 3), ("bangs", "!!" in text), ("asks", "??" in text)) if holds]


def is_given(feature: str) -> bool:
    """Whether a feature is a voter whatever the labels say."""
    return feature[0] in "#!"


@dataclass
class Model:
    """Weights by feature: a text's score is the sum over its features of weight * log(1 + count), and what its hits say."""

    weights: dict[str, float]
    voters: frozenset[str]
    hit_weights: tuple[float, ...]
    bias: float
    empty: bool = False

    def scorer(self):
        by_word: dict[str, tuple] = {}

        def lookup(word: str) -> tuple:
            fs = [f for f in features_of(word) if f in self.weights]
            return tuple(fs), any(f in self.voters and not is_given(f) for f in fs)

        def score(text: str | None) -> float:
            if self.empty:
                return 0.0
            counts, hits, kinds = Counter(), 0, set()
            words = Counter(words_of(text))
            for w, n in words.items():
                found = by_word.get(w)
                if found is None:
                    if len(by_word) > 1_000_000:
                        by_word.clear()
                    found = by_word[w] = lookup(w) if w else ((), False)
                fs, hit = found
                for f in fs:
                    counts[f] += n
                if hit:
                    hits += n
                    kinds.add(w)
            counts.update(f for f in signals_of(text, sum(words.values())) if f in self.weights)
            z = self.bias + sum(self.weights[f] * math.log1p(n) for f, n in sorted(counts.items()))
            z += sum(w * x for w, x in zip(self.hit_weights, hit_features(hits, len(kinds), sum(words.values())), strict=True))
            return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

        return score


def hit_features(hits: int, kinds: int, words: int) -> list[float]:
    return [*(float(hits >= k) for k in HITS), math.log1p(kinds), math.log1p(1000 * hits / words) if words else 0.0]


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """y, text of at most ``sample`` labelled rows that aren't held out."""
    known = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("y"))
    known = known.groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("text"))
    found = texts.join(F.broadcast(known), "_id").groupBy("_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))  # bounded by sample
    return stage(found.select("y", "text"), "toxicity-sample")


def _feature_support(rows: DataFrame) -> dict[str, tuple[int, int]]:
    """Rows with each feature: in all, and toxic ones. Features of few toxic rows are only counted where they're common."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, toxic = Counter(), Counter()
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                found = {f for w in set(words) for f in features_of(w)} | set(signals_of(text, len(words)))
                every.update(found)
                if y:
                    toxic.update(found)
        names = list(every)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([every[x] for x in names], pa.int64()), pa.array([toxic[x] for x in names], pa.int64())], names=["feature", "n", "n_toxic"])

    counted = rows.mapInArrow(count, "feature string, n long, n_toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    total = rows.count()
    sure = (F.col("n_toxic") >= MIN_SUPPORT) & (F.col("n_toxic") + 0.0 >= MIN_PRECISION * (F.col("n") + 0.5))
    kept = counted.where(sure | (F.col("n") >= max(20, total // 100)) | F.substring("feature", 1, 1).isin("#", "!"))
    return {x["feature"]: (x["n"], x["n_toxic"]) for x in kept.collect()}


def choose_voters(support: dict[str, tuple[int, int]], rows: int, toxic: int) -> tuple[list[str], list[str]]:
    """The voters, and other words for the classifier."""
    sure = {f: n for f, n in support.items() if not is_given(f) and n[1] >= MIN_SUPPORT and n[1] >= MIN_PRECISION * (n[0] + 0.5)}
    # a beginning that is sure explains the words and longer beginnings under it
    beginnings = {f[:-1] for f in sure if f.endswith("*")}
    explained = lambda f: any(f[:k] in beginnings for k in BEGINNINGS if k < len(f.rstrip("*")))
    voters = sorted(f for f in sure if not explained(f)) + sorted(f for f in support if is_given(f))

    def says(f: str) -> float:
        n, t = support[f]
        return abs(math.log((t + 0.5) / (toxic + 1)) - math.log((n - t + 0.5) / (rows - toxic + 1))) * math.sqrt(n)

    others = sorted((f for f in support if f not in sure and not f.endswith("*") and not is_given(f)), key=lambda f: (-says(f), f))[:OTHER_WORDS]
    return voters, others


class Sparse:
    """A matrix by its entries that aren't 0: products with vectors, and blocks of columns."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: tuple[int, int]):
        self.rows, self.cols, self.values, self.shape = rows, cols, values.astype(np.float64), shape

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * v[self.cols], self.shape[0])

    def turned_times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, self.values * v[self.rows], self.shape[1])

    def columns(self, first: int, end: int) -> np.ndarray:
        at = (self.cols >= first) & (self.cols < end)
        out = np.zeros((self.shape[0], end - first), np.float32)
        out[self.rows[at], self.cols[at] - first] = self.values[at]
        return out


def shared_residuals(fires: Sparse, post: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For each voter the sum of the correlations, from 0.1 on, of its residuals with every voter's, itself included.

    A voter's residual is its vote less what the row's class leads one to expect. Blocks of voters are
    compared, so memory holds two blocks of columns.
    """
    n, m = fires.shape

    def residuals(first: int) -> np.ndarray:
        end = min(first + BLOCK, m)
        x = fires.columns(first, end) - np.outer(post, p[1, first:end]) - np.outer(1 - post, p[0, first:end])
        x -= x.mean(0)
        return (x / (x.std(0) + 1e-9)).astype(np.float32)

    out = np.zeros(m)
    for a in range(0, m, BLOCK):
        one = residuals(a)
        for b in range(0, m, BLOCK):
            shared = np.abs(one.T @ (one if a == b else residuals(b)) / n)
            out[a : a + BLOCK] += np.where(shared < 0.1, 0, shared).sum(1)
    return out


def label_model(fires: Sparse, hits: np.ndarray, start: np.ndarray, prior: float) -> np.ndarray:
    """Posterior probability of "toxic" for each row from the votes: word voters fire or are silent, counting voters say yes or no."""
    n, m = fires.shape
    counting = np.stack([hits >= k for k in HITS], 1)
    votes = Sparse(np.r_[fires.rows, np.nonzero(counting)[0]], np.r_[fires.cols, m + np.nonzero(counting)[1]], np.ones(len(fires.rows) + int(counting.sum())), (n, m + len(HITS)))
    post = np.clip(start, 0.05, 0.95)
    weight = np.ones(m + len(HITS))
    for turn in range(ROUNDS):
        mass = np.array([(1 - post).sum(), post.sum()])
        p = np.array([(votes.turned_times(q) + 0.1) / (w + 0.3) for q, w in ((1 - post, mass[0]), (post, mass[1]))])  # P(vote | class), smoothed
        if turn % 10 == 5:  # what voters share beyond the class lowers the weight of all of them
            weight = 1 / np.maximum(shared_residuals(votes, post, p), 1)
        silent = weight * np.log((1 - p[1]) / (1 - p[0]))
        ratio = votes.times(weight * np.log(p[1] / p[0]) - silent) + silent.sum()
        new = 1 / (1 + np.exp(-np.clip(ratio + math.log(prior / (1 - prior)), -30, 30)))
        done = np.abs(new - post).max() < 1e-4
        post = new
        if done and turn > 10:
            break
    return post


def _fit_linear(x: Sparse, target: np.ndarray) -> np.ndarray:
    """Logistic regression on soft labels, a weight for each column and the bias last: gradient steps with momentum on scaled columns."""
    n, m = x.shape
    scale = np.sqrt(np.bincount(x.cols, x.values**2, m) / n) + 1e-6
    z = Sparse(np.r_[x.rows, np.arange(n)], np.r_[x.cols, np.full(n, m)], np.r_[x.values / scale[x.cols], np.ones(n)], (n, m + 1))
    share = np.where(target > 0.5, 0.5 / max(target.mean(), 1e-3), 0.5 / max(1 - target.mean(), 1e-3))
    u = np.ones(m + 1)
    for _ in range(20):  # the largest singular value, squared, by power iteration
        u = z.turned_times(z.times(u / np.linalg.norm(u)))
    rate = 4.0 / max(1.0, 1.1 * np.linalg.norm(u) * share.max() / n / 4)
    w, v = np.zeros(m + 1), np.zeros(m + 1)
    for _ in range(STEPS):
        g = z.turned_times((1 / (1 + np.exp(-np.clip(z.times(w), -30, 30))) - target) * share) / n + RIDGE * np.r_[w[:-1], 0]
        v = 0.9 * v - rate * g / 4
        w = w + v
    return np.r_[w[:-1] / scale, w[-1]]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    rows = training_rows(docs, labels, id_col, text_col, label_col, sample)
    total, toxic = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    none = Model({}, frozenset(), (0.0,) * (len(HITS) + 2), 0.0, empty=True)
    if not toxic:
        return none
    voters, others = choose_voters(_feature_support(rows), total, toxic)
    if not voters:
        return none
    columns = {f: i for i, f in enumerate([*voters, *others])}
    mined = frozenset(i for f, i in columns.items() if i < len(voters) and not is_given(f))

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts, hits, kinds, n = Counter(), 0, 0, 0
                for w, k in Counter(words_of(text)).items():
                    at = [columns[f] for f in features_of(w) if f in columns]
                    n += k
                    for i in at:
                        counts[i] += k
                    if any(i in mined for i in at):
                        hits, kinds = hits + k, kinds + 1
                counts.update(columns[f] for f in signals_of(text, n) if f in columns)
                out.append((y, list(counts), list(counts.values()), hits, kinds, n))
            types = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=["y", "at", "count", "hits", "kinds", "n_words"])

    found = rows.mapInArrow(design, "y int, at array<int>, count array<int>, hits long, kinds long, n_words long").collect()  # at most sample rows
    row = np.repeat(np.arange(len(found)), [len(r["at"]) for r in found])
    at = np.array([i for r in found for i in r["at"]], np.int64)
    count = np.log1p(np.array([k for r in found for k in r["count"]], np.float64))
    votes = at < len(voters)
    fires = Sparse(row[votes], at[votes], np.ones(votes.sum()), (len(found), len(voters)))
    post = label_model(fires, np.array([r["hits"] for r in found]), np.array([float(r["y"]) for r in found]), toxic / total)
    extra = np.array([hit_features(r["hits"], r["kinds"], r["n_words"]) for r in found])
    more = np.nonzero(extra)
    x = Sparse(np.r_[row, more[0]], np.r_[at, len(columns) + more[1]], np.r_[count, extra[more]], (len(found), len(columns) + extra.shape[1]))
    w = _fit_linear(x, post)
    return Model({f: float(w[i]) for f, i in columns.items()}, frozenset(voters), tuple(float(v) for v in w[len(columns) : -1]), float(w[-1]))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    # plain values, a few thousand weights: workers needn't know this package to read them
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.voters, model.hit_weights, model.bias, model.empty))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Model(*shared.value).scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([of(x.as_py()) for x in batch.column("text")], pa.float64())], names=["doc_id", "score"])
        give_back()

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
