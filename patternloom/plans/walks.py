"""Walks over the context-pattern graph, distributional scores, and bootstrapping loops."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.score import Scorer, score, top_results, update_weights
from ..operators.stats import counted, extract, global_counts, other, project, total_pairs, with_global

_own: str | None = None


def shared(spark) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one of our own on a local master (tests), else an error."""
    global _own
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    _own = _own or tempfile.mkdtemp(prefix="patternloom-")
    return _own


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a round's frame to the shared folder and read it back, so lineage doesn't grow with rounds."""
    path = os.path.join(shared(df.sparkSession), f"walk-{uuid.uuid4().hex}-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(pairs: DataFrame) -> DataFrame:
    """Pairs counted once and held, for plans that use them several times; held ones stay as they are."""
    return pairs if "matches" in pairs.columns else settle(counted(pairs), "pairs")


def hop(pairs: DataFrame, seeds: DataFrame, side: str = "context", min_matches: int = 1, global_stats: bool = True, keep_unmatched: bool = False) -> DataFrame:
    """From seeds on one side to statistics with the other: context to pattern, or pattern to context."""
    pairs = settled(pairs)
    stats = extract(pairs, project(seeds, side), side, min_matches, keep_unmatched)
    if not global_stats:
        return stats
    stats = settle(stats, "matches")  # read for the values to be counted and for the rows
    return with_global(stats, global_counts(pairs, stats, other(side)), other(side))


def context_to_pattern(pairs: DataFrame, seeds: DataFrame, **options) -> DataFrame:
    return hop(pairs, seeds, "context", **options)


def pattern_to_context(pairs: DataFrame, seeds: DataFrame, **options) -> DataFrame:
    return hop(pairs, seeds, "pattern", **options)


def context_to_context(pairs: DataFrame, seeds: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(pattern statistics, context statistics) of a walk of two hops."""
    pairs = settled(pairs)
    first = settle(context_to_pattern(pairs, seeds, **options), "hop")
    return first, pattern_to_context(pairs, first, **options)


def pattern_to_pattern(pairs: DataFrame, seeds: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    pairs = settled(pairs)
    first = settle(pattern_to_context(pairs, seeds, **options), "hop")
    return first, context_to_pattern(pairs, first, **options)


def context_scores(context_stats: DataFrame, by: Scorer, total, pattern_stats: DataFrame | None = None, pattern_by: Scorer | None = None) -> DataFrame:
    """Score contexts; with a pattern scorer, patterns are scored first and become the weights."""
    if pattern_by is not None:
        context_stats = update_weights(context_stats, score(pattern_stats, pattern_by, "pattern", total), "pattern")
    return score(context_stats, by, "context", total)


def pattern_scores(pattern_stats: DataFrame, by: Scorer, total, context_stats: DataFrame | None = None, context_by: Scorer | None = None) -> DataFrame:
    if context_by is not None:
        pattern_stats = update_weights(pattern_stats, score(context_stats, context_by, "context", total), "context")
    return score(pattern_stats, by, "pattern", total)


def bootstrap(pairs: DataFrame, seeds: DataFrame, by: Scorer, keep: int, target: str = "context", min_matches: int = 1, rounds: int = 1) -> DataFrame:
    """Grow contexts (or patterns) from seeds of the same side: expand to the opposite side, score it, keep the
    best ``keep`` times the round (all if negative), go back and score.  The result of a round seeds the next."""
    far = other(target)
    pairs = settled(pairs)
    total = settle(total_pairs(pairs), "total")
    current = seeds
    for i in range(1, rounds + 1):
        out = settle(hop(pairs, current, target, min_matches), "hop")
        scored = score(out, by, far, total)
        if keep >= 0:
            scored = top_results(scored, keep * i, (far,))
        back = hop(pairs, settle(scored.withColumnRenamed("score", "weight"), "round"), far, min_matches)
        result = settle(score(back, by, target, total), "round")
        current = result.withColumnRenamed("score", "weight")
    return result
