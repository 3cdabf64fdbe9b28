"""Learned decision lists over text statistics (operator 3).

Sequential covering: rules that reject are grown one threshold at a time by
information gain on two thirds of the labelled sample, pruned on the rest,
and kept while they are precise there; the rows that a rule covers are set
aside before the next one is grown.  The result is an ordered Spark CASE
expression; rows that no rule covers are kept.

Statistics come from one pass over whole texts and are held as narrow rows;
the learner sees at most ``limit`` labelled rows (a documented bound).  Nulls
and empty texts count as no words, so they fail the base rule.  Without
labels, or without labelled rows to reject, the list is empty and only the
base rule decides.  Ties between thresholds go to the first in the order of
statistics; rows that repeat are judged each (for training the smallest counts);
an empty table gives an empty result.  Only doc_id and text are read, so
further columns, whatever their names, don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import labelled, spill
from ._stats import RATIOS, ratio, ratios, with_stats


@dataclass
class Rule:
    """All of the conditions (name, at_least, threshold) hold; precision is that on the pruning rows."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)
    precision: float = 0.0
    covered: int = 0

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for n, up, t in self.conditions:
            out &= x[n] >= t if up else x[n] <= t
        return out

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for n, up, t in self.conditions:
            out &= ratio(n, prefix) >= t if up else ratio(n, prefix) <= t
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if up else '<='} {t:.6g}" for n, up, t in self.conditions)


def _grow(x: dict, bad: np.ndarray, cuts: dict, deep: int) -> Rule:
    rule, live = Rule(), np.ones(len(bad), bool)
    for _ in range(deep):
        p, n = int((live & bad).sum()), int((live & ~bad).sum())
        if not n or not p:
            break
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for name, ts in cuts.items():
            v = x[name][live]
            b = bad[live]
            order = np.argsort(v, kind="stable")
            vs, cum = v[order], np.concatenate([[0], np.cumsum(b[order])])
            for up in (True, False):
                k = np.searchsorted(vs, ts, side="left" if up else "right")
                pp = cum[-1] - cum[k] if up else cum[k]
                tot = len(vs) - k if up else k
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / np.maximum(tot, 1)) - base), -1.0)
                if len(gain) and gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = (float(gain[i]), (name, up, float(ts[i])))
        if best[1] is None:
            break
        rule.conditions.append(best[1])
        live = rule.mask(x)
    return rule


def _prune(rule: Rule, x: dict, bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        m = r.mask(x)
        p, n = int((m & bad).sum()), int((m & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule.conditions) - 1, 0, -1):
        if worth(shorter := Rule(rule.conditions[:k])) >= worth(best):
            best = shorter
    m = best.mask(x)
    p = int((m & bad).sum())
    best.covered, best.precision = int(m.sum()), (p + 1) / (int(m.sum()) + 2)
    return best


def learn(x: dict[str, np.ndarray], label: np.ndarray, most: int = 24, deep: int = 4, precise: float = 0.8, least: int = 2, seed: int = 0) -> list[Rule]:
    """Ordered rules that reject. x: ratios of the sample; label: 0 is to be rejected."""
    bad, rules = label == 0, []
    rng = np.random.default_rng(seed)
    part = rng.random(len(bad)) < 2 / 3
    left = np.ones(len(bad), bool)
    # midpoints between neighbouring quantiles of values
    cuts = {}
    for n, v in x.items():
        u = np.unique(np.quantile(v, np.linspace(0, 1, 257))) if len(v) else np.zeros(0)
        cuts[n] = (u[1:] + u[:-1]) / 2
    for _ in range(most):
        g, p = left & part, left & ~part
        if not (g & bad).any():
            break
        rule = _grow({n: v[g] for n, v in x.items()}, bad[g], cuts, deep)
        if not rule.conditions:
            break
        rule = _prune(rule, {n: v[p] for n, v in x.items()}, bad[p])
        if rule.covered < least or rule.precision < min(precise, (rule.covered + 1) / (rule.covered + 2)):
            break
        rules.append(rule)
        left &= ~rule.mask(x)
    return rules


def decide(rules: list[Rule], prefix: str = "") -> Column:
    """The list as an ordered expression: the number of the first rule that rejects, or null."""
    out = None
    for k, r in enumerate(rules):
        out = F.when(r.column(prefix), F.lit(k)) if out is None else out.when(r.column(prefix), F.lit(k))
    return (out if out is not None else F.lit(None)).cast("int")


def base_failed(prefix: str = "") -> Column:
    w, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (w < 10) | (100 * r > 20 * w)


def apply(docs: DataFrame, labels: DataFrame, limit: int = 20_000, seed: int = 0) -> tuple[DataFrame, list[Rule]]:
    """Statistics, base verdict, number of the rejecting rule and verdict of every row of docs (doc_id, text)."""
    table = spill(with_stats(docs.select("doc_id", "text")).drop("text"), "stats")
    # held-out rows (crc32 mod 5 = 0) never train
    trains = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 != 0
    seen = labelled(table, labels, "quality", trains, limit, seed, columns=tuple(table.columns))
    seen = seen.where(~base_failed()).select(*ratios(), "label").toArrow()
    rules = learn({n: seen[n].to_numpy() for n in RATIOS}, seen["label"].to_numpy(), seed=seed)
    out = table.withColumn("base_failed", base_failed()).withColumn("rule", decide(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules
