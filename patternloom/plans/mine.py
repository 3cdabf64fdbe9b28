"""Mining plans: paraphrases and pattern sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.extract import pair_counts
from ..operators.score import top_results

PATTERNS = 500  # tested in a pass


def paraphrases(pairs: DataFrame, k: int, min_matches: int = 1, scope: str = "document", places: int | None = None) -> DataFrame:
    """(id, pattern, score): for each pattern its k best substitutes (itself too), by summed products of shares.

    Shares are within (docid, context), or within the context over all
    documents with scope ``corpus``.  ``places`` rounds scores before they are ranked.
    """
    group = ["docid", "context"] if scope == "document" else ["context"]
    counts = pair_counts(pairs, min_matches)
    if scope == "corpus":
        counts = counts.groupBy("context", "pattern").agg(F.sum("matches").alias("matches"))
    # sums by an aggregate with partial sums, so a frequent context loads no task
    sums = counts.groupBy(*group).agg(F.sum("matches").alias("_all"))
    shares = counts.join(sums, group).withColumn("p", F.col("matches") / F.col("_all")).drop("_all")
    a = shares.select(*group, F.col("pattern").alias("id"), F.col("p").alias("p_a"))
    b = shares.select(*group, "pattern", F.col("p").alias("p_b"))
    scored = a.join(b, group).groupBy("id", "pattern").agg(F.sum(F.col("p_a") * F.col("p_b")).alias("score"))
    if places is not None:
        scored = scored.withColumn("score", F.round("score", places))
    return top_results(scored, k, ("pattern",), summed=True)


def pattern_sentences(sentences: DataFrame, patterns: list[str]) -> DataFrame:
    """(pattern, sentence) of each pattern (a regular expression) found in each sentence.

    A pass takes PATTERNS of them, tested on each sentence; more patterns take
    more passes, so that no expression grows with their number.
    """
    out = None
    for k in range(0, max(1, len(patterns)), PATTERNS):
        found = F.array(F.lit(None).cast("string"), *[F.when(F.col("sentence").rlike(p), F.lit(p)) for p in patterns[k : k + PATTERNS]])
        part = sentences.select(F.explode(F.filter(found, lambda p: p.isNotNull())).alias("pattern"), "sentence")
        out = part if out is None else out.unionByName(part)
    return out
