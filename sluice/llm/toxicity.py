"""Toxicity scores from a counterfactual-regularised linear classifier.

A document's logit comes from the scores of its different words; a word's score
is the sum of hashed weights of the word and of its character n-grams, so the
model is linear and every word has one fixed score that workers keep.  Training
minimises log loss plus two penalties: the usual one on weights, and for each
labelled text that names a group, the squared change of its score when the name
is swapped for others of its kind.  A neutral mention of a group then moves a
score as little as the mention of any other group.

Words are pooled in two steps.  The first fits word scores on sums over a text,
scaled by the root of the number of words.  The second fits a handful of
coefficients over pools of word scores (mean, largest, largest few), on word
scores fitted to the other half of the texts, so that a few hostile words in a
very long text still count.

Null and empty texts are texts without words; they get the intercept's score.
Null ids pass through.  Repeated rows get equal scores.  An empty table, or one
with labels of one class only, gives the smoothed share of label 1.
"""

from __future__ import annotations

import re
import sys
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import fields, map_batches
from sluice.llm.numeric import Adam, Sparse, csr, sigmoid

WORD = re.compile(r"\w+")

#: Names of groups by kind; names of one kind stand in for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "citizen", "refugee", "foreigner"),
    ("immigrants", "citizens", "refugees", "foreigners"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)


@dataclass(frozen=True)
class Settings:
    """sample: the most labelled texts of each class that are fitted on, taken by hash of id.
    bits: log2 of the number of hashed weights.  least: the texts a weight must occur in.
    swaps: counterfactuals a text.  fairness, ridge: weights of the penalties."""

    sample: int = 3000
    bits: int = 18
    least: int = 4
    swaps: int = 3
    fairness: float = 5.0
    ridge: float = 2e-4
    steps: int = 120


def words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def features(word: str, bits: int) -> list[int]:
    """Hashed ids of the word itself and of its 3- to 5-grams with ends marked."""
    marked, mask = f"<{word}>".encode(), (1 << bits) - 1
    grams = {zlib.crc32(marked[i : i + n]) & mask for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
    return [zlib.crc32(b"=" + word.encode()) & mask, *grams]


@dataclass
class Model:
    weights: np.ndarray
    pool: np.ndarray
    bits: int

    def word_score(self, word: str) -> float:
        return float(self.weights[features(word, self.bits)].sum())

    def score(self, scores: np.ndarray) -> float:
        return float(sigmoid(pooled(scores) @ self.pool))


def pooled(scores: np.ndarray) -> np.ndarray:
    """Intercept, scaled sum, largest, and means of the largest 3 and 10 (missing ones count 0)."""
    if not len(scores):
        return np.array([1.0, 0, 0, 0, 0])
    top = np.zeros(10)
    high = np.sort(scores)[::-1][:10]
    top[: len(high)] = high
    return np.array([1.0, scores.sum() / np.sqrt(len(scores)), top[0], top[:3].mean(), top.mean()])


def swapped(bag: set[str], swaps: int) -> list[tuple[list[str], list[str]]]:
    """Counterfactuals of a bag of words: (names taken out, names put in)."""
    pairs = []
    for shift in range(1, swaps + 1):
        out, put = [], []
        for kind in IDENTITY_TERMS:
            for i, name in enumerate(kind):
                if name in bag and shift < len(kind):
                    out.append(name)
                    put.append(kind[(i + shift) % len(kind)])
        if out:
            pairs.append((out, put))
    return pairs


def fit_weights(docs: Sparse, grams: Sparse, scale: np.ndarray, y: np.ndarray, swaps: Sparse, settings: Settings) -> np.ndarray:
    """Weights of hashed features; ``docs`` has words by text, ``grams`` features by word."""
    seen = grams.t_dot(np.bincount(docs.cols, minlength=docs.width).astype(float))
    usable = seen >= settings.least
    grams = grams.columns(usable)
    weights, bias = np.zeros(grams.width), np.zeros(1)
    adam = Adam([weights, bias], 0.05)
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(settings.steps):
        score = grams.dot(weights)
        error = (sigmoid(docs.dot(score) * scale + bias) - y) * balance / len(y)
        slope = docs.t_dot(error * scale)
        if len(swaps.starts) > 1:
            slope += 2 * settings.fairness / (len(swaps.starts) - 1) * swaps.t_dot(swaps.dot(score))
        adam.step([grams.t_dot(slope) + settings.ridge * weights, np.array([error.sum()])])
    return weights


def fit(bags: list[tuple[str, ...] | set[str]], labels: list[int], settings: Settings = Settings()) -> Model:
    """Fit on bags of different words with labels 0 and 1."""
    y = np.array(labels, float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    constant = np.array([np.log(share / (1 - share)), 0, 0, 0, 0])
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << settings.bits), constant, settings.bits)
    pairs = [(i, p) for i, bag in enumerate(bags) for p in swapped(set(bag), settings.swaps)]
    vocabulary: dict[str, int] = {}
    index = lambda names: np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in names), np.int32)
    rows = [index(sorted(bag)) for bag in bags]
    out, put = [index(p[0]) for _, p in pairs], [index(p[1]) for _, p in pairs]
    n = len(vocabulary)
    grams = csr([np.array(features(w, settings.bits), np.int32) for w in vocabulary], 1 << settings.bits)
    scale = np.array([1 / np.sqrt(max(1, len(r))) for r in rows])

    def deltas(keep: np.ndarray) -> Sparse:
        chosen = [k for k, (i, _) in enumerate(pairs) if keep[i]]
        signs = [np.repeat([1.0, -1.0], [len(out[k]), len(put[k])]) for k in chosen]
        return csr([np.concatenate([out[k], put[k]]) for k in chosen], n, np.concatenate(signs) if chosen else np.zeros(0))

    def train(keep: np.ndarray) -> np.ndarray:
        return fit_weights(csr([r for r, k in zip(rows, keep, strict=True) if k], n), grams, scale[keep], y[keep], deltas(keep), settings)

    half = np.where(y > 0, np.cumsum(y > 0), np.cumsum(y <= 0)) % 2 == 0  # of each class
    x = np.zeros((len(y), 5))
    for keep in (half, ~half):
        if 0 < y[keep].sum() < keep.sum():
            score = grams.dot(train(keep))
            for i in np.flatnonzero(~keep):
                x[i] = pooled(score[rows[i]])
    everything = np.ones(len(y), bool)
    weights = train(everything)
    pool = np.zeros(5)
    size = np.maximum(np.abs(x).max(axis=0), 1e-9)
    adam = Adam([pool], 0.1)
    for _ in range(1500):
        error = sigmoid((x / size) @ pool) - y
        adam.step([(x / size).T @ error / len(y) + 1e-5 * pool])
    return Model(weights, pool / size, settings.bits)


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, per_class: int) -> list[tuple[tuple[str, ...], int]]:
    """Bags of words of at most ``per_class`` labelled texts of each class, by hash of id.

    Ids are chosen from the labels alone and then fetch their texts, so no text
    that isn't fitted on is moved.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"))
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").drop("_z")  # labels that clash teach nothing
    chosen = [known.where(F.col("_y") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for c in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * per_class rows of 12 bytes

    def make():
        def work(batch: pa.RecordBatch):
            ids, bags, ys = [], [], []
            for i, text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids.append(i)
                bags.append(" ".join(sorted(words(text))))
                ys.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bags, pa.string()), pa.array(ys, pa.int32())], ["_id", "bag", "_y"])

        return work

    found = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(ids, "_id").select("_id", "_text", "_y")
    rows = map_batches(found, "_id long, bag string, _y int", make).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r._id).encode()), r._id, r.bag))
    # One object for each different word, whatever the number of texts that have it.
    return [(tuple(map(sys.intern, r.bag.split())), r._y) for r in rows]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of ``docs``; whole texts, no shuffle."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2**bits weights, whatever the input

    def make():
        model, known = shared.value, {}

        def work(batch: pa.RecordBatch):
            scores = []
            for text in batch.column(1).to_pylist():
                bag = words(text)
                for w in bag:
                    if w not in known:
                        known[w] = model.word_score(w)
                scores.append(model.score(np.fromiter(map(known.__getitem__, bag), float, len(bag))))
                if len(known) > 1_000_000:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [id_col, "score"])

        return work

    return map_batches(docs.select(id_col, text_col), fields(docs, id_col, "score double"), make)


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Fit on the labelled texts and score all of ``docs``."""
    sample = sample_labelled(docs, labels, label, id_col, text_col, settings.sample)
    return score(docs, fit([b for b, _ in sample], [y for _, y in sample], settings), id_col, text_col)
