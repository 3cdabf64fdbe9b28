"""Match statistics of seeds against pairs; one side's field is dropped as NULL, never marked by a string.

Pairs are rows (docid, context, pattern), or counted ones (context, pattern, matches) from ``counted``; a plan that
uses them several times counts once and reads the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a seed table up to this many rows is broadcast; a larger one is joined by shuffle
BROADCAST_ROWS = 200_000


def other(side: str) -> str:
    return {"context": "pattern", "pattern": "context"}[side]


def read_seeds(seeds: DataFrame, side: str) -> DataFrame:
    """Seeds with a value on the side, weights as doubles; literal ``*`` is no value."""
    value = F.when(F.col(side) != "*", F.col(side))
    return seeds.select("id", value.alias(side), F.col("weight").cast("double").alias("weight")).where(F.col(side).isNotNull())


def project(rows: DataFrame, key: str = "pattern+context") -> DataFrame:
    """Sum weights over the fields that the key drops: ``pattern``, ``context`` or ``pattern+context``."""
    fields = {"pattern": ["pattern"], "context": ["context"], "pattern+context": ["context", "pattern"]}[key]
    return rows.groupBy("id", *fields).agg(F.sum("weight").alias("weight"))


def counted(pairs: DataFrame) -> DataFrame:
    """(context, pattern, matches) of pairs; counted ones stay as they are."""
    if "matches" in pairs.columns:
        return pairs
    return pairs.groupBy("context", "pattern").agg(F.count("*").alias("matches"))


def _times(pairs: DataFrame) -> Column:
    return F.sum("matches") if "matches" in pairs.columns else F.count("*")


def extract(pairs: DataFrame, seeds: DataFrame, side: str = "context", min_matches: int = 1, keep_unmatched: bool = False) -> DataFrame:
    """Matches of seeds (id, side, weight) in pairs, one row for each (id, context, pattern).

    The global count of the seeds' own side is the number of all its matches,
    also of those under min_matches.  keep_unmatched gives seeds without a
    match a row with 0 matches.
    """
    far, own = other(side), f"global_{side}_count"
    seeds = seeds.groupBy("id", side).agg(F.max("weight").alias("weight"))
    # counting before the join shrinks what is shuffled
    counts = counted(pairs)
    # a seed's own count doesn't depend on the id: an aggregate with partial sums, so a frequent seed loads no task
    few = F.broadcast if seeds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda df: df
    sums = counts.join(few(seeds.select(side).distinct()), side, "left_semi").groupBy(side).agg(F.sum("matches").alias(own))
    seeds = seeds.join(few(sums), side, "left")
    rows = counts.join(seeds, side, "right") if keep_unmatched else counts.join(few(seeds), side)
    rows = rows.where((F.col("matches") >= min_matches) | F.col("matches").isNull()) if keep_unmatched else rows.where(F.col("matches") >= min_matches)
    if keep_unmatched:
        # a seed all of whose matches are too few has no match either
        none = seeds.join(rows.select("id", side).distinct(), ["id", side], "left_anti").withColumns({far: F.lit(None).cast("string"), "matches": F.lit(0).cast("long")})
        rows = rows.unionByName(none.select(*rows.columns))
        rows = rows.withColumns({"matches": F.coalesce("matches", F.lit(0).cast("long")), own: F.coalesce(own, F.lit(0).cast("long"))})
    return rows.select("id", "context", "pattern", "matches", F.lit(0).cast("long").alias(f"global_{far}_count"), f"global_{side}_count", "weight")


def global_counts(pairs: DataFrame, examples: DataFrame, side: str) -> DataFrame:
    """(side, count): how often each value of the examples occurs in all pairs."""
    wanted = examples.select(side).where(F.col(side).isNotNull()).distinct()
    return pairs.join(wanted, side, "left_semi").groupBy(side).agg(_times(pairs).alias("count"))


def total_pairs(pairs: DataFrame) -> DataFrame:
    """One row: the number of pairs."""
    return pairs.agg(F.coalesce(_times(pairs), F.lit(0).cast("long")).alias("total"))


def combine(*parts: DataFrame) -> DataFrame:
    """Sum counts of equal (id, context, pattern) over parts; weights agree, so the greatest is taken."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    sums = [F.sum(c).alias(c) for c in ("matches", "global_pattern_count", "global_context_count")]
    return rows.groupBy("id", "context", "pattern").agg(*sums, F.max("weight").alias("weight"))


def with_global(stats: DataFrame, counts: DataFrame, side: str) -> DataFrame:
    """stats with the global count of the side from counts (side, count); 0 where there is none."""
    column = f"global_{side}_count"
    joined = stats.drop(column).join(counts.select(side, F.col("count").alias(column)), side, "left")
    return joined.withColumn(column, F.coalesce(column, F.lit(0))).select("id", "context", "pattern", "matches", "global_pattern_count", "global_context_count", "weight")
