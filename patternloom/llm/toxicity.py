"""Toxic passages by maximum-scoring segments (operator 2).

Words, and word beginnings of a few lengths, get log-odds between toxic and clean labelled texts under a Dirichlet
prior (the words' pooled shares times ``prior``).  A word counts with the greatest lower end of its intervals (its own,
its beginnings') that is at least ``least``; else, where its own upper end is below ``-drift``, with that, to ``-most``;
any other word with ``-drift``.  A linear-time scan (Ruzzo and Tompa) finds all maximal-scoring segments of a text.
Their scores are calibrated by extreme-value theory: lambda solves the Karlin equation over the words of clean texts,
and K is the maximum-likelihood value for the best segments of clean texts that gave no word scores.  A segment of
score S in n words has E = K n exp(-lambda S); segments with E below ``significant`` are passages, and the text's
evidence is the sum of their -ln E.  A logistic fit of the evidence on labelled texts that gave no word scores makes
it a probability.

The model is fitted on at most ``limit`` labelled rows (held-out rows, crc32
mod 3 = 1, never), a documented bound; it holds every word of them that passes
the test, and scoring covers every whole text.  Null and empty texts have no
evidence and get the probability of none.  Without both labels every score is
0.5.  Ties between segments go to the left one; rows that repeat a doc_id are
scored each (for training the smallest text counts).  An empty table gives an
empty result.  Columns of docs named like results are kept with the prefix
``document_``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import give_way, labelled, map_batches

#: lengths (bytes) of word beginnings that count beside whole words: stems with varying endings
HEADS = (4, 5, 6, 7)

COUNTED = "hash long, word string, toxic long, clean long"
SCORED = "n_words long, evidence double, score double, passages array<struct<start:long,end:long,score:double>>"


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (from, to exclusive, score) of a sequence, in linear time."""
    total, out = 0.0, []  # out: (from, to, sum before, sum up to), candidates
    left: list[int] = []  # for each candidate, the nearest earlier one with a smaller sum before
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = (i, i + 1, before, total)
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j = left[j]
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                left.append(j)
                break
            new = (out[j][0], new[1], out[j][2], new[3])
            del out[j:], left[j:]
    return [(a, b, r - l) for a, b, l, r in out]


@dataclass
class Model:
    hashes: np.ndarray  # sorted uint64
    weights: np.ndarray
    drift: float
    lam: float
    k: float
    significant: float
    slope: float = 1.0
    bias: float = 0.0

    def lookup(self, w: W.Words) -> np.ndarray:
        out = np.full(len(w.hash), -self.drift)
        if len(self.hashes):
            for k, h in enumerate((w.hash, *w.heads.T)):
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = np.flatnonzero(self.hashes[at] == h)
                out[hit] = np.maximum(out[hit], self.weights[at[hit]]) if k else self.weights[at[hit]]
        return out

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * np.log1p(evidence), -500, 500)))

    def found(self, arr) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Words, and all maximal-scoring segments (byte offsets within the text, score), of each text."""
        data, offs = W.column(arr)
        n = len(offs) - 1
        count, where = np.zeros(n, np.int64), [[] for _ in range(n)]
        for lo, hi in W.slices(offs):
            w = W.scan(data, offs, lo, hi, W.ALPHA, lower=True, heads=HEADS)
            b = w.bounds()
            count[lo:hi] = np.diff(b)
            s = self.lookup(w)
            up = np.flatnonzero(s > 0)
            total = np.concatenate([[0.0], np.cumsum(s)])
            for r in np.unique(w.row[up]):
                at = up[np.searchsorted(up, b[r]) : np.searchsorted(up, b[r + 1])]
                # words between two positive ones are one negative step
                steps = np.empty(2 * len(at) - 1)
                steps[0::2] = s[at]
                steps[1::2] = total[at[1:]] - total[at[:-1] + 1]
                base = int(offs[lo + r])
                for a, z, score in segments(steps.tolist()):
                    where[lo + r].append((int(w.start[at[a // 2]]) - base, int(w.end[at[(z - 1) // 2]]) - base, float(score)))
        return count, where

    def value(self, n: int, score: float) -> float:
        """-ln E of a segment in n words."""
        return self.lam * score - float(np.log(self.k * max(n, 1)))

    def evidence(self, n: int, scores: list[float]) -> float:
        return sum(e for e in (self.value(n, s) for s in scores) if e > -np.log(self.significant))


def count_words(rows: DataFrame) -> DataFrame:
    """(hash, word, toxic, clean): occurrences by label over rows (text, label)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offs = W.column(batch.column(0))
            label = batch.column(1).to_numpy(zero_copy_only=False) > 0
            for lo, hi in W.slices(offs, 8 * W.BLOCK):
                for a, z in W.slices(offs[lo : hi + 1]):
                    w = W.scan(data, offs, lo + a, lo + z, W.ALPHA, lower=True, heads=HEADS)
                    for k, hashes in enumerate((w.hash, *w.heads.T)):
                        there = np.flatnonzero(hashes != 0)
                        h, first, inv = np.unique(hashes[there], return_index=True, return_inverse=True)
                        bad = np.bincount(inv, weights=label[lo + a + w.row[there]], minlength=len(h)).astype(np.int64)
                        n = np.bincount(inv, minlength=len(h)).astype(np.int64)
                        cut, mark = (HEADS[k - 1], "*") if k else (64, "")
                        word = [W.LOWER[data[w.start[i] : min(w.end[i], w.start[i] + cut)]].tobytes().decode(errors="ignore") + mark for i in there[first]]
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(word, pa.string()), pa.array(bad), pa.array(n - bad)], names=["hash", "word", "toxic", "clean"])

    return map_batches(rows.select("text", "label"), run, COUNTED).groupBy("hash").agg(F.min("word").alias("word"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, limit: int = 20_000, prior: float = 1000.0, least: float = 1.0, drift: float = 0.02, most: float = 0.1, significant: float = 0.01, seed: int = 0) -> Model:
    trains = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 3 != 1
    rows = labelled(docs, labels, "toxic", trains, limit, seed)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(4))
    counts = count_words(rows.where(fold > 0))
    totals = counts.where("not endswith(word, '*')").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    # log-odds under the prior, and their deviation (Monroe et al.)
    share = (F.col("toxic") + F.col("clean")) / (F.col("t") + F.col("c")) * prior
    a, b = F.col("toxic") + share, F.col("clean") + share
    odds = F.log(a / (F.col("t") + prior - a)) - F.log(b / (F.col("c") + prior - b))
    sd = F.sqrt(1 / a + 1 / b)
    scored = counts.crossJoin(F.broadcast(totals)).where("t > 0 and c > 0")  # totals is one row
    scored = scored.select("hash", "clean", "c", "toxic", F.endswith("word", F.lit("*")).alias("head"), (odds - 2.0 * sd).alias("low"), (odds + 2.0 * sd).alias("high"))
    # a row for each word that passes the test, of at most ``limit`` texts
    words = scored.where(f"low > {least} and toxic > 1 or high < {-drift} and not head").orderBy("hash").toArrow()
    order = np.argsort(words["hash"].to_numpy().view(np.uint64))
    hashes, low, high = (words[c].to_numpy()[order] for c in ("hash", "low", "high"))
    weights = np.where(low > least, low, np.maximum(high, -most))
    lam = 1.0
    if (weights > 0).any():
        # a word's share among clean words; of words and beginnings that overlap each counts, which errs to the safe side
        p = (words["clean"].to_numpy()[order] + 0.5) / words["c"].to_numpy()[0]
        whole = ~words["head"].to_numpy(zero_copy_only=False)[order]
        rest = max(1e-9, 1 - p[whole].sum())
        below, above = 1e-6, 50.0
        for _ in range(100):
            lam = (below + above) / 2
            with np.errstate(over="ignore"):
                grows = (p * np.exp(np.minimum(lam * weights, 700))).sum() + rest * np.exp(-lam * drift) > 1 + p[~whole].sum()
            below, above = (below, lam) if grows else (lam, above)
    model = Model(hashes.view(np.uint64), weights, drift, lam, 0.1, significant)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches):
        import pyarrow as pa

        for batch in batches:
            n, where = shared.value.found(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n), pa.array([[x[2] for x in w] for w in where], pa.list_(pa.float64()))], names=["label", "n", "scores"])

    seen = map_batches(rows.where(fold == 0).select("text", "label"), weigh, "label int, n long, scores array<double>").toArrow()
    label, n, scores = seen["label"].to_numpy(), seen["n"].to_numpy(), seen["scores"].to_pylist()
    # best segments of clean texts follow P(M < x) = exp(-K n exp(-lambda x)), cut off at 0
    best = np.array([max(x, default=0.0) for x in scores])
    clean = label == 0
    model.k = float(((clean & (best > 0)).sum() + 1) / ((n * np.exp(-lam * best))[clean].sum() + 10))
    model.slope, model.bias = _logistic(np.log1p([model.evidence(a, b) for a, b in zip(n.tolist(), scores, strict=True)]), label)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    if not len(y) or y.min() == y.max():
        return 0.0, 0.0
    f, w = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        step = np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + ridge * np.eye(2), f.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with n_words, evidence, score and passages (code points, end exclusive)."""
    docs = give_way(docs, ("n_words", "evidence", "score", "passages"))
    columns = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + SCORED
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        m = shared.value
        for batch in batches:
            arr = batch.column(columns.index(text))
            n, where = m.found(arr)
            evidence, spans = np.zeros(len(n)), []
            for r, found in enumerate(where):
                count = int(n[r])
                evidence[r] = m.evidence(count, [x[2] for x in found])
                found = [x for x in found if m.value(count, x[2]) > -np.log(m.significant)]
                raw = arr[r].as_py().encode() if found else b""
                spans.append([{"start": len(raw[:a].decode(errors="ignore")), "end": len(raw[:z].decode(errors="ignore")), "score": s} for a, z, s in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(evidence), pa.array(m.probability(evidence)), pa.array(spans, kind)], names=[*columns, "n_words", "evidence", "score", "passages"])

    return map_batches(docs, run, schema)


def report(docs: DataFrame, labels: DataFrame, cut: float = 0.7, **options) -> DataFrame:
    """One row per document: doc_id, score, predicted, and the number of passages."""
    model = fit(docs, labels, **options)
    out = score(docs.select("doc_id", "text"), model).drop("text")
    return out.select("doc_id", "score", (F.col("score") >= cut).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
