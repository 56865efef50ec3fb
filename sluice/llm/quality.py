"""Text quality from positives and unlabelled text (PU learning).

Trusted positives are texts labelled good; everything else is unlabelled text
in which good and bad are mixed.  A small network over measures of a text's
shape minimises the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with logistic losses, so its sigmoid estimates the chance that a text is good.
The class prior comes from the data too: first networks tell positives from
unlabelled text, and the prior is the least ratio, over score thresholds, of
the unlabelled share to the positive share above it, each text scored by the network
that wasn't fitted on its half.  The intercept is set last, so that the mean score of
unlabelled text is the prior.  Labels of bad texts are never used.

Networks are fitted to bounded samples; the unlabelled shares and the mean score are
counted over all texts.  Texts are measured once: measures are written down, and what
follows reads them.

Null and empty texts have all measures 0 and a defined score; null ids pass
through; equal texts get equal scores.  Without positives or without texts the
score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import fields, map_batches, persist
from sluice.llm.numeric import Adam, sigmoid

LETTERS = re.compile(r"[^\W\d_]")
MARKS = re.compile(r"[^\w\s.,;:'\"()?-]")
ENDS = re.compile(r"[.?]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
CLEAN = re.compile(r"[^\W\d_]+[.,;:?]?")
MEASURES = 20


@dataclass(frozen=True)
class Settings:
    """positives, unlabelled: the most texts of each that are fitted on, taken by hash of id."""

    positives: int = 4000
    unlabelled: int = 8000
    hidden: int = 24
    steps: int = 1500
    batch: int = 1024
    seed: int = 7


def measures(text: str | None) -> np.ndarray:
    """Measures of the whole text's shape."""
    out = np.zeros(MEASURES)
    tokens = text.split() if text else []
    if not tokens:
        return out
    n, chars = len(tokens), len(text)
    counts = Counter(tokens)
    letters = len(LETTERS.findall(text))
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = Counter(zip(tokens, tokens[1:], strict=False))
    lengths = np.fromiter(map(len, tokens), float, n)
    repeated = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
    folded = Counter(w.strip(".,;:!?").lower() for w in tokens)
    out[:] = (
        np.log1p(n),
        len(counts) / n,
        len(counts) / np.sqrt(n),
        lengths.mean() / 10,
        lengths.std() / 10,
        letters / chars,
        len(UPPER.findall(text)) / max(1, letters),
        len(MARKS.findall(text)) / n,
        len(ENDS.findall(text)) / n,
        text.count(",") / n,
        sum(map(str.isdigit, text)) / chars,
        counts.most_common(1)[0][1] / n,
        sum(c for _, c in folded.most_common(10)) / n,
        repeated / n,
        1 - len(pairs) / max(1, n - 1),
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(lines)) / np.log1p(n),
        sum(1 for w in tokens if CLEAN.fullmatch(w)) / n,
        float((lengths <= 3).mean()),
        sum(1 for w in tokens if w.isupper() and len(w) > 1) / n,
    )
    return out


@dataclass
class Network:
    """One hidden layer over standardised measures and their quantile position."""

    centre: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -6, 6)

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(self.inputs(x) @ w1 + b1) @ w2 + b2[0]


def train(x_pos: np.ndarray, x_unl: np.ndarray, prior: float | None, settings: Settings) -> Network:
    """With a prior: the non-negative PU risk.  Without: plain positives against unlabelled."""
    rng = np.random.default_rng(settings.seed)
    both = np.concatenate([x_pos, x_unl])
    centre = np.median(both, axis=0)
    spread = np.maximum(np.quantile(both, 0.9, axis=0) - np.quantile(both, 0.1, axis=0), 1e-3)
    k = both.shape[1]
    layers = [rng.normal(0, 1 / np.sqrt(k), (k, settings.hidden)), np.zeros(settings.hidden), rng.normal(0, 0.1, settings.hidden), np.zeros(1)]
    net = Network(centre, spread, layers)
    zp, zu = net.inputs(x_pos), net.inputs(x_unl)
    adam = Adam(layers, 0.01)
    for _ in range(settings.steps):
        p, u = zp[rng.integers(0, len(zp), settings.batch)], zu[rng.integers(0, len(zu), settings.batch)]
        z = np.concatenate([p, u])
        hidden = np.tanh(z @ layers[0] + layers[1])
        logit = hidden @ layers[2] + layers[3][0]
        s = sigmoid(logit)
        sp, su = s[: len(p)], s[len(p) :]
        if prior is None:
            slope = np.concatenate([(sp - 1) / len(p), su / len(u)])
        else:
            negative = np.log1p(np.exp(np.minimum(logit[len(p) :], 30))).mean() - prior * np.log1p(np.exp(np.minimum(logit[: len(p)], 30))).mean()
            away = np.concatenate([-prior * sp / len(p), su / len(u)])
            # Below zero the negative part overfits: step back along it, as the non-negative estimator does.
            slope = np.concatenate([prior * (sp - 1) / len(p), np.zeros(len(u))]) + away if negative >= 0 else -away
        back = np.outer(slope, layers[2]) * (1 - hidden**2)
        adam.step([z.T @ back + 1e-4 * layers[0], back.sum(0), hidden.T @ slope + 1e-4 * layers[2], np.array([slope.sum()])])
    return net


def cuts_of(pos: np.ndarray) -> np.ndarray:
    """Thresholds at which tails of scores are compared."""
    return np.unique(np.quantile(pos, np.linspace(0.02, 0.7, 69)))


def prior_of(pos: np.ndarray, cuts: np.ndarray, above: np.ndarray, n: int) -> tuple[float, float]:
    """The share of positives in ``n`` unlabelled scores of which ``above`` reach the cuts, and the same less its sampling error.

    Above a threshold that only positives reach, unlabelled text is as much rarer
    as positives are in it, so the least ratio of upper tails is the share.
    """
    best, least = 1.0, 1.0
    for c, reached in zip(cuts, above / max(1, n), strict=True):
        p, u = (pos >= c).mean(), float(reached)
        error = np.sqrt((1 - p) / (p * len(pos)) + (1 - u) / (max(u, 1e-9) * n))
        best, least = min(best, u / p), min(least, u / p * (1 - error))
    return float(np.clip(best, 0.05, 0.98)), float(np.clip(least, 0.05, 0.98))


def class_prior(pos: np.ndarray, unl: np.ndarray) -> tuple[float, float]:
    """:func:`prior_of` of scores that are at hand."""
    cuts = cuts_of(pos)
    return prior_of(pos, cuts, np.array([(unl >= c).sum() for c in cuts]), len(unl))


@dataclass
class Model:
    net: Network | None
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.net is None else sigmoid(self.net.logit(x))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, MEASURES)


def counted(held: DataFrame, place: Callable[[np.ndarray, np.ndarray], np.ndarray], bins: int) -> np.ndarray:
    """How many of all texts lie in each bin: ``place`` of their measures and halves."""

    def make():
        def work(batch: pa.RecordBatch):
            n = np.bincount(place(matrix(batch.column(1)), batch.column(0).to_numpy()), minlength=bins)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["bin", "n"])

        return work

    out = np.zeros(bins, np.int64)
    for r in map_batches(held.select("_half", "x"), "bin int, n long", make).groupBy("bin").agg(F.sum("n").alias("n")).collect():  # a row a bin
        out[r["bin"]] = r["n"]
    return out


#: Bins of logits, from which the intercept is set.
EDGES = np.linspace(-30, 30, 6001)


def learn(held: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", settings: Settings = Settings()) -> Model:
    """A model from measured texts (:func:`measured`) and the labels of trusted positives."""
    (x_pos, h_pos), (x_unl, h_unl) = sample(held, labels, label, id_col, settings)
    if min(len(x_pos), len(x_unl)) < 2:
        return Model(None, 0.5)
    if min((h == k).sum() for h in (h_pos, h_unl) for k in (0, 1)) < 2:  # too few for halves by id
        nets = [train(x_pos, x_unl, None, replace(settings, steps=settings.steps // 4))] * 2
    else:
        nets = [train(x_pos[h_pos == k], x_unl[h_unl == k], None, replace(settings, steps=settings.steps // 4)) for k in (0, 1)]
    other = lambda x, half: np.where(half == 0, nets[1].logit(x), nets[0].logit(x))
    pos = other(x_pos, h_pos)
    cuts = cuts_of(pos)
    below = counted(held, lambda x, half: np.searchsorted(cuts, other(x, half), side="right"), len(cuts) + 1)
    prior, least = prior_of(pos, cuts, below.sum() - np.cumsum(below)[:-1], int(below.sum()))
    # A prior that is too high leaves the risk nothing to call bad; one that is too low costs little.
    net = train(x_pos, x_unl, least, settings)
    logits = counted(held, lambda x, _: np.searchsorted(EDGES, np.clip(net.logit(x), EDGES[0], EDGES[-1])), len(EDGES))
    net.layers[3] += shift(EDGES, logits, prior)
    return Model(net, prior)


def shift(logits: np.ndarray, weights: np.ndarray, prior: float) -> float:
    """What to add to logits so that the mean chance over unlabelled text is the prior."""
    low, high = -20.0, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if np.average(sigmoid(logits + middle), weights=weights) < prior else (low, middle)
    return middle


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """(id, _key, _half, x) of every row, written down: measures of whole texts, and a half by hash of the key (else of the id)."""
    key = (F.col(id_col) if key is None else key).cast("long")
    own = docs.select(F.col(id_col).alias("_id"), key.alias("_key"), crc_half(key).alias("_half"), F.col(text_col).alias("_text"))

    def make():
        def work(batch: pa.RecordBatch):
            x = np.concatenate([measures(t) for t in batch.column(3).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, MEASURES), pa.int32()), pa.array(x))], ["_id", "_key", "_half", "x"])

        return work

    return persist(map_batches(own, fields(own, "_id", "_key long, _half int, x array<double>"), make), "measures").withColumnRenamed("_id", id_col)


def crc_half(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 2, F.lit(0)).cast("int")


def sample(held: DataFrame, labels: DataFrame, label: str, id_col: str, settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """(measures, halves) of bounded samples of the trusted positives and of all texts."""
    good = labels.where((F.col(label) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_key")).distinct()
    good = good.orderBy(F.xxhash64("_key"), "_key").limit(settings.positives).withColumn("_y", F.lit(1))
    some = held.where("_key is not null").select("_key").distinct()
    some = some.orderBy(F.xxhash64("_key", F.lit(3)), "_key").limit(settings.unlabelled).withColumn("_y", F.lit(0))
    ids = F.broadcast(good.unionByName(some))  # at most positives + unlabelled rows of 12 bytes
    found = held.select("_key", "_half", "x").join(ids, "_key").collect()
    rows = sorted((r._y, zlib.crc32(str(r._key).encode()), r._key, r.x, r._half) for r in found)
    return [(np.array([r[3] for r in rows if r[0] == y]).reshape(-1, MEASURES), np.array([r[4] for r in rows if r[0] == y], int)) for y in (1, 0)]


def scored(held: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of measured texts."""
    own = held.select(F.col(id_col).alias("_id"), "x")

    def make():
        def work(batch: pa.RecordBatch):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(matrix(batch.column(1))), pa.float64())], ["_id", "score"])

        return work

    return map_batches(own, fields(own, "_id", "score double"), make).withColumnRenamed("_id", id_col)


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Fit on trusted positives and unlabelled texts and score all of ``docs``."""
    held = measured(docs, id_col, text_col)
    return scored(held, learn(held, labels, label, id_col, settings), id_col)
