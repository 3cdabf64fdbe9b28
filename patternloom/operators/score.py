"""Scorers, and the jobs that apply, combine and rank scores.

A scorer is a row expression, a static expression and a final expression.  m:
matches, gp and gc: global counts of the pattern and the context, N: all
pairs, w: weight; n: distinct opposite values of an id, W: their weights.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import other

#: fixed value: Okapi's saturation constant
OKAPI_K1 = 1.75


@dataclass(frozen=True)
class Scorer:
    """row(side), static(side) and final(score, static, n, W) as columns; needs_total: uses N and global counts."""

    row: Callable[[str], Column]
    static: Callable[[str], Column]
    final: Callable[[Column, Column, Column, Column], Column]
    needs_total: bool = False


def _own(side: str) -> Column:
    return F.col(f"global_{side}_count").cast("double")


def _mean(score: Column, static: Column, n: Column, total: Column) -> Column:
    return score / total


_M, _W, _N = (lambda: F.col("matches").cast("double")), (lambda: F.col("weight")), (lambda: F.col("total").cast("double"))


def pmi(smooth: float = 0.0, expected: bool = False) -> Scorer:
    """w ln(m N / ((gp + s)(gc + s))), 0 where a factor is; expected: times m / N."""

    def row(side: str) -> Column:
        a, b = _own("pattern") + smooth, _own("context") + smooth
        value = F.log(_M() * _N() / (a * b))
        value = value * _M() / _N() if expected else value
        return F.when((_M() == 0) | (_N() == 0) | (a == 0) | (b == 0), 0.0).otherwise(_W() * value)

    return Scorer(row, lambda side: F.lit(0.0), _mean, True)


def likelihood() -> Scorer:
    """w m over the global count of the opposite side."""
    return Scorer(lambda side: F.when(_own(other(side)) == 0, 0.0).otherwise(_W() * _M() / _own(other(side))), lambda side: F.lit(0.0), _mean)


def tfidf(tf: str = "tf", idf: str = "idf") -> Scorer:
    tfs = {"binary": lambda: F.when(_M() > 0, 1.0).otherwise(0.0), "tf": _M, "log": lambda: F.log(_M() + 1), "okapi": lambda: _M() * (OKAPI_K1 + 1) / (_M() + OKAPI_K1)}
    idfs = {
        "none": lambda cf: F.lit(1.0),
        "idf": lambda cf: F.log(_N() / cf),
        "okapi": lambda cf: F.log((_N() - cf + 0.5) / (cf + 0.5)),
    }
    if tf not in tfs or idf not in idfs:
        raise ValueError(f"tfidf {tf}:{idf}")
    return Scorer(lambda side: _W() * tfs[tf]() * idfs[idf](_own(side)), lambda side: F.lit(0.0), _mean, idf != "none")


def fmeasure(lam: float = 0.5) -> Scorer:
    """Weighted harmonic mean of the share of matched weight and the share of the value's own occurrences."""
    return Scorer(
        lambda side: F.when(_M() > 0, _W()).otherwise(0.0),
        _own,
        lambda score, static, n, total: n * (score / total) / ((1 - lam) * static + lam * n),
    )


def scorer(name: str, args: str | None = None) -> Scorer:
    """By name and colon-delimited arguments: pmi ``pmi[:s]`` or ``emim[:s]``, likelihood, tfidf ``tf:idf``, fmeasure ``lambda``."""
    parts = args.split(":") if args else []
    if name == "pmi":
        if not parts or parts[0] not in ("pmi", "emim"):
            raise ValueError("pmi needs pmi or emim")
        return pmi(float(parts[1]) if len(parts) > 1 else 0.0, parts[0] == "emim")
    if name == "likelihood":
        if parts:
            raise ValueError("likelihood has no arguments")
        return likelihood()
    if name == "tfidf":
        return tfidf(*parts)
    if name == "fmeasure":
        return fmeasure(*(float(p) for p in parts))
    raise ValueError(f"no scorer {name!r}")


def score(stats: DataFrame, by: Scorer, side: str = "pattern", total: DataFrame | int | None = None) -> DataFrame:
    """(id, side, score) of each value of the side, from stats against the opposite side.

    Counts and weights of distinct opposite values come from one aggregation by
    (id, opposite value), so nothing is expanded for the distinct count.
    """
    far = other(side)
    if by.needs_total and total is None:
        raise ValueError("this scorer needs the number of pairs and global counts")
    if isinstance(total, DataFrame):
        stats = stats.crossJoin(F.broadcast(total.select("total")))  # one row
    elif total is not None:
        stats = stats.withColumn("total", F.lit(total))
    else:
        stats = stats.withColumn("total", F.lit(0))
    per = stats.groupBy("id", side).agg(F.sum(by.row(side)).alias("_score"), F.max(by.static(side)).alias("_static"))
    whole = stats.groupBy("id", far).agg(F.max("weight").alias("_w")).groupBy("id").agg(F.count("*").cast("double").alias("_n"), F.sum("_w").alias("_total"))
    joined = per.join(whole, "id")
    return joined.select("id", side, by.final(F.col("_score"), F.col("_static"), F.col("_n"), F.col("_total")).alias("score"))


def update_weights(stats: DataFrame, scores: DataFrame, side: str) -> DataFrame:
    """stats with the weight replaced by the score of (id, side); rows without one go."""
    return stats.drop("weight").join(scores.select("id", side, F.col("score").alias("weight")), ["id", side]).select("id", "context", "pattern", "matches", "global_pattern_count", "global_context_count", "weight")


def top_results(scores: DataFrame, k: int, fields: tuple[str, ...] = ("context", "pattern"), summed: bool = False) -> DataFrame:
    """Of each id the k highest sums of scores of a key; ties by the key.  ``summed``: keys are distinct already."""
    rows = scores.select("id", *fields, "score") if summed else scores.groupBy("id", *fields).agg(F.sum("score").alias("score"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), *fields)
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def combine_scores(rows: DataFrame, score_column: str = "score") -> DataFrame:
    """Sum the score over equal values of all other columns."""
    keys = [c for c in rows.columns if c != score_column]
    return rows.groupBy(*keys).agg(F.sum(score_column).alias(score_column))
