"""Bradley-Terry quality ranking (operator 6).

Preference pairs (a document labelled 1 over one labelled 0) train a linear
score of text statistics by logistic loss on feature differences; the score
is then cut at the quantile of the training scores that separates the labels
best, which becomes the probability ``cut`` (0.3).

Training takes at most ``limit`` labelled rows and ``pairs`` pairs per fit, a
documented bound; scoring is a Spark expression over statistics of every
whole text.  An empty or null text has the statistics of no words and gets a
score like any other.  Without labelled rows of both kinds every score is 0.5.
Of cuts that separate equally well the middle is taken; rows that repeat are
scored each (for training the smallest counts); an empty table gives an empty
result.  Further columns, whatever their names, don't matter and are kept by
``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import labelled, spill
from ._stats import RATIOS, ratio, ratios, with_stats

NAMES = tuple(RATIOS)


def _features(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / sd, -6, 6)
    return np.hstack([z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0)])


@dataclass
class Ranking:
    mean: np.ndarray
    sd: np.ndarray
    weight: np.ndarray
    at: float  # raw score of the cut
    scale: float
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _features(x, self.mean, self.sd) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-((self.raw(x) - self.at) * self.scale + np.log(self.cut / (1 - self.cut)))))

    def column(self, prefix: str = "") -> Column:
        """The score as an expression over the statistics' columns."""
        k, out = len(NAMES), F.lit(0.0)
        for i, n in enumerate(NAMES):
            z = F.least(F.greatest((ratio(n, prefix) - float(self.mean[i])) / float(self.sd[i]), F.lit(-6.0)), F.lit(6.0))
            out += z * float(self.weight[i]) + F.greatest(z - 1, F.lit(0.0)) * float(self.weight[k + i]) + F.greatest(-z - 1, F.lit(0.0)) * float(self.weight[2 * k + i])
        logit = (out - float(self.at)) * float(self.scale) + float(np.log(self.cut / (1 - self.cut)))
        return 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(500.0)), F.lit(-500.0))))


def fit(x: np.ndarray, label: np.ndarray, cut: float = 0.3, pairs: int = 60_000, ridge: float = 1e-3, steps: int = 30, seed: int = 0) -> Ranking:
    """x: rows of ratios; label: 0 or 1."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    mean, sd = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    if not len(good) or not len(bad):
        return Ranking(mean, sd, np.zeros(3 * len(NAMES)), 0.0, 1.0, 0.5)
    rng = np.random.default_rng(seed)
    f = _features(x, mean, sd)
    d = f[rng.choice(good, pairs)] - f[rng.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(steps):  # Newton on the mean logistic loss of differences
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / len(d) + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = f @ w
    qs = np.quantile(s, np.linspace(0, 1, 2001))
    sg, sb = np.sort(s[good]), np.sort(s[bad])
    # losing a good document weighs as much as three bad ones kept
    right = 3 * (1 - np.searchsorted(sg, qs) / len(sg)) + np.searchsorted(sb, qs) / len(sb)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    at = float((qs[best[0]] + qs[best[-1]]) / 2)
    # the spread of scores around the cut sets the slope
    scale = 4.0 / max(float(np.median(sg) - np.median(sb)), 1e-6)
    return Ranking(mean, sd, w, at, scale, cut)


def _trains() -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 != 0


def train(stats: DataFrame, labels: DataFrame, cut: float = 0.3, limit: int = 20_000, seed: int = 0) -> Ranking:
    """From statistics (doc_id and COUNTS) of documents; held-out rows (crc32 mod 5 = 0) never train."""
    seen = labelled(stats, labels, "quality", _trains(), limit, seed, columns=tuple(stats.columns)).select(*ratios(), "label").toArrow()
    x = np.column_stack([seen[n].to_numpy() for n in NAMES]) if seen.num_rows else np.zeros((0, len(NAMES)))
    return fit(x, seen["label"].to_numpy(), cut, seed=seed)


def score(docs: DataFrame, labels: DataFrame, cut: float = 0.3, limit: int = 20_000, seed: int = 0) -> tuple[DataFrame, Ranking]:
    """(doc_id, statistics, score, predicted) of every row of docs, in one pass over the texts."""
    table = spill(with_stats(docs.select("doc_id", "text")).drop("text"), "stats")
    model = train(table, labels, cut, limit, seed)
    return table.withColumn("score", model.column()).withColumn("predicted", (F.col("score") >= cut).cast("int")), model


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3, limit: int = 20_000, seed: int = 0) -> DataFrame:
    """docs without those that score below the cut; columns as they are."""
    sample = labelled(docs, labels, "quality", _trains(), limit, seed).drop("label")
    model = train(with_stats(sample).drop("text"), labels, cut, limit, seed)
    names = {c: f"_loom_d{k}" for k, c in enumerate(docs.columns) if c != "text"}
    scored = with_stats(docs.withColumnsRenamed(names), prefix="_q_")
    return scored.where(model.column("_q_") >= cut).select(*[names.get(c, c) for c in docs.columns]).withColumnsRenamed({v: k for k, v in names.items()})
