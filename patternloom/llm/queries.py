"""Queries of the operators, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report

    return report(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import report

    out = report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_passages")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply

    out, _ = apply(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import join

    return join(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import groups

    return groups(read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import score

    out, _ = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import report

    return report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import report

    return report(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign

    out = assign(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_ngram_join": op4_ngram_join,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_decontamination": op7_decontamination,
    "op8_secret_scan": op8_secret_scan,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Queries that SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op4_ngram_join": rf"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i : array_to_string(ws[i:i + 4], ' '))) END) AS g FROM w),
same AS (SELECT doc_id, g, CASE WHEN len(g) > 0 THEN min(doc_id) OVER (PARTITION BY g) ELSE doc_id END AS node FROM s),
post AS MATERIALIZED (SELECT node, len(g) AS n, unnest(g) AS sh FROM same WHERE doc_id = node),
pair AS (SELECT a.node AS u, b.node AS v FROM post a JOIN post b ON a.sh = b.sh AND a.node < b.node AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
         GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edge AS MATERIALIZED (SELECT u, v FROM pair UNION SELECT v, u FROM pair),
reach AS (SELECT u, v FROM edge UNION SELECT reach.u, edge.v FROM reach JOIN edge ON reach.v = edge.u),
least_of AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(node, coalesce(m, node)) AS component_id FROM same LEFT JOIN least_of ON node = u
""",
    "op7_decontamination": rf"""
WITH
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS win
        FROM (SELECT item_id, ws, least(len(ws), 10) AS k, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM i WHERE len(ws) > 0)),
spot AS (SELECT doc_id, p, k, array_to_string(ws[p:p + k - 1], ' ') AS win
       FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT k FROM win) WHERE len(ws) >= k)),
hit AS MATERIALIZED (SELECT doc_id, p, k, item_id FROM spot JOIN win USING (k, win)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(id) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
""",
}
