"""The pipeline's stages over small tables, against plain versions of the stages that SQL can't express."""

import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from patternloom.llm import mixing, ngram_join, quality_classifier, queries
from patternloom.llm._shared import read

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_run(spark):
    docs = read(spark, DATA, "documents")
    left = docs
    for name, stage in corpus_pipeline.STAGES:
        before, left = left, corpus_pipeline.spill(stage(spark, left, DATA), name)
        if name != "shards":
            assert left.columns == docs.columns
        if name == "quality":
            scores = quality_classifier.score(before, read(spark, DATA, "labels"))[0]
            assert scores.count() == before.count() and left.count() == scores.where("score >= 0.3").count()
        if name == "near_duplicates":
            joined = {r.doc_id: r.component_id for r in ngram_join.join(before).collect()}
            assert sorted(r.doc_id for r in left.collect()) == sorted(k for k, c in joined.items() if k == c)
        if name == "mix":
            want = Counter({r.doc_id: r.repeats for r in mixing.mix(before).collect() if r.repeats})
            assert Counter(r.doc_id for r in left.collect()) == want
    rows = left.collect()
    assert {"shard", "slot"} <= set(left.columns) and all(0 <= r.shard < 16 for r in rows)
    assert Counter((r.doc_id) for r in corpus_pipeline.run(spark, DATA).collect()) == Counter(r.doc_id for r in rows)
    assert all(not re.search("!!", r.text or "") for r in rows)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _odd(spark):
    """Nulls in every column, blank and long texts, repeated rows, and columns named like the stages' own."""
    long = " ".join(f"word{k}" for k in range(20_000))
    words = "some quite ordinary words that make up a text of more than ten of them"
    rows = [(1, words, "en", "a", 1), (1, words, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (4, long, "en", None, 9), (None, words + " again", "en", "a", 3), (None, None, None, None, None), (5, words.upper(), "en", "b", 2)]
    names = ["size", "shard", "slot", "score", "n_hit", "repeats", "pattern", "_key", "_row", "_maybe", "_k0", "n_words"]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCS).select("*", *[F.lit(k + 100).alias(c) for k, c in enumerate(names)]), names


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_with_odd_rows(spark, name):
    """Each stage by itself: rows are kept or go as a whole, columns stay, an empty table gives an empty result."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs, names = _odd(spark)
    got = stage(spark, docs, DATA)
    rows = got.collect()
    own = {"shards": lambda c: f"document_{c}" if c in ("size", "shard", "slot") else c}.get(name, lambda c: c)
    if name != "shards":
        assert got.columns == docs.columns
    assert all(r[own(c)] == k + 100 for r in rows for k, c in enumerate(names))
    left = Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows)
    every = Counter(tuple(r[:5]) for r in docs.collect())
    assert set(left) <= set(every)
    if name in ("shards", "decontamination"):
        assert left == every
    if name == "near_duplicates":  # one row of the copies; rows without words, or without an id, stay
        assert sum(n for k, n in left.items() if k[0] in (1, 5)) == 1 and all(left[k] == n for k, n in every.items() if k[0] not in (1, 5))
    if name == "mix":
        assert all(n <= 3 * every[k] for k, n in left.items())
    assert stage(spark, docs.where("false"), DATA).count() == 0


def test_decontamination_against_plain_windows(spark):
    from patternloom.llm import decontaminate

    docs = read(spark, DATA, "documents")
    windows = set()
    for r in read(spark, DATA, "benchmark").collect():
        w = decontaminate.words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}
    want = []
    for r in docs.collect():
        w = decontaminate.words(r.text)
        if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)):
            want.append(r.doc_id)
    got = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, DATA)
    assert sorted(r.doc_id for r in got.collect()) == sorted(want) and len(want) < docs.count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_covers_table(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    docs = read(spark, DATA, "documents")
    ids = got.select("doc_id").distinct() if name == "op5_line_dedup" else got.select("doc_id")  # rows of that query are lines
    assert sorted(r.doc_id for r in ids.collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
