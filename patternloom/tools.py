"""Tools by name with keyword parameters: corpora by reader name, extractors and scorers by name and argument string.

``python -m patternloom.tools TOOL -key=value ...`` or ``TOOL params.tsv``
(one ``name<TAB>value`` in a line) runs a tool and writes its result.
"""

from __future__ import annotations

import inspect
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import nlp
from .functions.tokenize import sentences
from .operators import extract as ex
from .operators import score as sc
from .operators import stats as st
from .plans import instances, mine, relations, walks
from .sources import readers, writers

CORPORA: dict[str, Callable[[SparkSession, str], DataFrame]] = {"lines": readers.lines, "files": readers.whole_files, "trec": readers.trec, "posts": readers.posts, "warc": readers.warc, "parsed": readers.parsed}


def _flag(s: str) -> bool:
    return s.lower() == "true"


def extractor(name: str, args: str = "") -> Callable[[DataFrame], DataFrame]:
    """A function from a corpus to pairs.

    ngram ``minCtx:maxCtx:maxPat:maxSkip:style``, chunk ``surface:maxSkip:style``,
    nary ``arity:maxSkip``, dirt ``style[:headOnly:lemmas]``, cooccur and
    post_cooccur ``maxGram``, geo_temporal ``maxGram:grain:left:right:geo:temporal``,
    passage ``sub;subArgs;size;increment``, multi ``name|args|name|args...``.
    """
    a = args.split(":")
    if name == "ngram":
        lo, hi, most, skip = map(int, a[:4])
        return lambda docs: ex.ngram_pairs(_tokens(docs), lo, hi, most, skip, a[4])
    if name == "cooccur":
        return lambda docs: ex.cooccurrence_pairs(_tokens(docs), int(a[0]))
    if name == "post_cooccur":
        return lambda docs: ex.post_cooccurrence(docs, int(a[0]))
    if name == "geo_temporal":
        return lambda docs: ex.geo_temporal_pairs(docs, int(a[0]), a[1], int(a[2]), int(a[3]), _flag(a[4]), _flag(a[5]))
    if name == "chunk":
        return lambda docs: nlp.extract_chunks(docs, _flag(a[0]), int(a[1]), a[2])
    if name == "nary":
        return lambda docs: nlp.extract_nary(docs, int(a[0]), int(a[1]))
    if name == "dirt":
        return lambda docs: nlp.extract_paths(docs, a[0], *(_flag(x) for x in a[1:3]))
    if name == "passage":
        sub, sub_args, size, step = args.split(";")
        return lambda docs: ex.passage_pairs(_sentences(docs), extractor(sub, sub_args), int(size), int(step))
    if name == "multi":
        f = args.split("|")
        # a bar within the arguments of an n-gram style isn't a separator, as styles have none
        return lambda docs: ex.multi_pairs(docs, *(extractor(n, x) for n, x in zip(f[::2], f[1::2], strict=True)))
    raise ValueError(f"no extractor {name!r}")


def _tokens(docs: DataFrame) -> DataFrame:
    if "tokens" in docs.columns:
        return docs
    if "sentences" in docs.columns:
        return docs.select("docid", F.flatten(F.transform("sentences", lambda s: s["token"])).alias("tokens"))
    return ex.tokenized(docs, "tag", "content" if "content" in docs.columns else "text", "docid")


def _sentences(docs: DataFrame) -> DataFrame:
    if "sentences" in docs.columns:
        return docs.select("docid", F.transform("sentences", lambda s: F.array_join(s["token"], " ")).alias("sentences"))
    return docs.select("docid", sentences("content" if "content" in docs.columns else "text").alias("sentences"))


def _pairs(spark, corpus_path, corpus_class, extractor_class, extractor_args) -> DataFrame:
    return extractor(extractor_class, extractor_args)(CORPORA[corpus_class](spark, corpus_path))


def _hop(side: str, twice: bool):
    def tool(spark, seeds_path, corpus_path, corpus_class, extractor_class, extractor_args="", min_matches=1, global_stats=True, keep_unmatched=False):
        pairs = _pairs(spark, corpus_path, corpus_class, extractor_class, extractor_args)
        seeds = st.read_seeds(readers.seeds(spark, seeds_path), side)
        options = {"min_matches": int(min_matches), "global_stats": str(global_stats).lower() == "true", "keep_unmatched": str(keep_unmatched).lower() == "true"}
        if twice:
            return (walks.context_to_context if side == "context" else walks.pattern_to_pattern)(pairs, seeds, **options)[1]
        return walks.hop(pairs, seeds, side, **options)

    return tool


def _scores(side: str):
    def tool(spark, input_path, scorer_class, scorer_args=None, total=None):
        """total: the number of pairs, or the path of a table that has it as ``total``."""
        if total is not None:
            total = int(total) if str(total).isdigit() else spark.read.parquet(total).select("total").limit(1)
        return sc.score(spark.read.parquet(input_path), sc.scorer(scorer_class, scorer_args), side, total)

    return tool


def _computed(side: str):
    """Two hops from seeds, then scores; with a scorer of the other side its scores are the weights."""

    def tool(spark, seeds_path, corpus_path, corpus_class, extractor_class, extractor_args="", scorer_class="pmi", scorer_args=None, other_scorer_class=None, other_scorer_args=None, min_matches=1):
        pairs = walks.settled(_pairs(spark, corpus_path, corpus_class, extractor_class, extractor_args))
        seeds = st.read_seeds(readers.seeds(spark, seeds_path), side)
        two, scores = (walks.context_to_context, walks.context_scores) if side == "context" else (walks.pattern_to_pattern, walks.pattern_scores)
        first, second = two(pairs, seeds, min_matches=int(min_matches))
        other = sc.scorer(other_scorer_class, other_scorer_args) if other_scorer_class else None
        return scores(second, sc.scorer(scorer_class, scorer_args), st.total_pairs(pairs), first, other)

    return tool


def extract(spark, seeds_path, corpus_path, corpus_class, extractor_class, extractor_args="", extractor_target="context", min_matches=1, keep_unmatched=False):
    pairs = walks.settled(_pairs(spark, corpus_path, corpus_class, extractor_class, extractor_args))
    seeds = st.read_seeds(readers.seeds(spark, seeds_path), extractor_target)
    return st.extract(pairs, st.project(seeds, extractor_target), extractor_target, int(min_matches), str(keep_unmatched).lower() == "true")


def extract_global_stats(spark, input_path, corpus_path, corpus_class, extractor_class, extractor_args="", extractor_target="pattern"):
    """(value, count, total): global counts of a side of statistics, and the number of all pairs."""
    pairs = walks.settled(_pairs(spark, corpus_path, corpus_class, extractor_class, extractor_args))
    counts = st.global_counts(pairs, spark.read.parquet(input_path), extractor_target)
    return counts.crossJoin(F.broadcast(st.total_pairs(pairs)))  # one row


def combine_splits(spark, input_path, counts_path, extractor_target="pattern"):
    return st.with_global(spark.read.parquet(input_path), spark.read.parquet(counts_path), extractor_target)


def combine_stats(spark, input_path):
    """Several paths are comma-separated."""
    return st.combine(*[spark.read.parquet(p) for p in input_path.split(",")])


def _bootstrap(side: str):
    def tool(spark, input_path, corpus_path, corpus_class, extractor_class, extractor_args="", scorer_class="pmi", scorer_args=None, keep=-1, min_matches=1, num_iterations=1):
        pairs = _pairs(spark, corpus_path, corpus_class, extractor_class, extractor_args)
        seeds = st.read_seeds(readers.seeds(spark, input_path), side)
        return walks.bootstrap(pairs, seeds, sc.scorer(scorer_class, scorer_args), int(keep), side, int(min_matches), int(num_iterations))

    return tool


def context_pattern_pairs(spark, corpus_path, corpus_class, extractor_class, extractor_args="", min_matches=1):
    return ex.pair_counts(_pairs(spark, corpus_path, corpus_class, extractor_class, extractor_args), int(min_matches))


def paraphrase_candidates(spark, corpus_path, corpus_class, extractor_class, extractor_args="", num_results=10, min_matches=1):
    return mine.paraphrases(_pairs(spark, corpus_path, corpus_class, extractor_class, extractor_args), int(num_results), int(min_matches))


def harvest_sentences(spark, pattern_path, corpus_path, corpus_class):
    docs = CORPORA[corpus_class](spark, corpus_path)
    rows = docs.select(F.explode("sentences").alias("t")).select(nlp.render_sentence("t").alias("sentence")) if corpus_class == "parsed" else _sentences(docs).select(F.explode("sentences").alias("sentence"))
    return mine.pattern_sentences(rows, readers.regex_list(spark, pattern_path))


def annotate(spark, corpus_path, corpus_class, annotator=None):
    """annotator: an import path ``package.module:name``; unset, the rule annotator."""
    docs = CORPORA[corpus_class](spark, corpus_path)
    own = nlp.load_annotator(annotator) if annotator else nlp.rule_annotator
    return nlp.annotate(docs, own, text="content" if "content" in docs.columns else "text", docid="docid")


def _parsed(spark, corpus_path, corpus_class) -> DataFrame:
    return readers.parsed(spark, corpus_path) if corpus_class == "parsed" else annotate(spark, corpus_path, corpus_class)


def such_as_instances(spark, corpus_path, corpus_class, min_matches=1):
    return instances.instance_counts(instances.such_as_pairs(_parsed(spark, corpus_path, corpus_class)), int(min_matches))


def list_instances(spark, corpus_path, corpus_class):
    pairs = instances.such_as_pairs(_parsed(spark, corpus_path, corpus_class), lists=True)
    return instances.list_walk(pairs.select(F.col("context").alias("class"), F.col("pattern").alias("list")))


def parse_graph(spark, corpus_path, corpus_class="parsed"):
    return nlp.parse_graph(_parsed(spark, corpus_path, corpus_class))


def extract_relations(spark, types_path, primary_types, patterns_path, corpus_path, instances_path=None, extractor_class="nary", extractor_args="2:0", corpus_class="parsed"):
    """corpus_class other than ``parsed``: plain text, which the rule annotator parses first."""
    if extractor_class != "nary":
        raise ValueError("relations need the arguments that the extractor nary gives")
    docs, (arity, skip) = _parsed(spark, corpus_path, corpus_class), map(int, extractor_args.split(":"))
    more = readers.relation_patterns(spark, instances_path) if instances_path else None
    found = relations.relations(docs, readers.relation_types(spark, types_path), readers.relation_patterns(spark, patterns_path), more, arity, skip)
    primary = dict(p.split("|") for p in primary_types.split(","))
    return relations.to_xml(found, relations.individuals(docs, primary, arity, skip))


TOOLS: dict[str, Callable[..., DataFrame]] = {
    "context_to_pattern": _hop("context", False),
    "pattern_to_context": _hop("pattern", False),
    "context_to_context": _hop("context", True),
    "pattern_to_pattern": _hop("pattern", True),
    "score_patterns": _scores("pattern"),
    "score_contexts": _scores("context"),
    "bootstrap_contexts": _bootstrap("context"),
    "bootstrap_patterns": _bootstrap("pattern"),
    "context_pattern_pairs": context_pattern_pairs,
    "paraphrase_candidates": paraphrase_candidates,
    "harvest_sentences": harvest_sentences,
    "annotate": annotate,
    "such_as_instances": such_as_instances,
    "list_instances": list_instances,
    "parse_graph": parse_graph,
    "extract_relations": extract_relations,
    "project": lambda spark, input_path, split_key="pattern+context": st.project(spark.read.parquet(input_path), split_key),
    "combine_stats": combine_stats,
    "combine_splits": combine_splits,
    "compute_context_scores": _computed("context"),
    "compute_pattern_scores": _computed("pattern"),
    "extract": extract,
    "extract_global_stats": extract_global_stats,
    "update_weights": lambda spark, stats_path, scores_path, example_type: sc.update_weights(spark.read.parquet(stats_path), spark.read.parquet(scores_path), example_type),
    "top_results": lambda spark, input_path, num_results: sc.top_results(spark.read.parquet(input_path), int(num_results)),
    "combine_scores": lambda spark, input_path: sc.combine_scores(spark.read.parquet(input_path)),
    "examples": lambda spark, input_path: readers.seeds(spark, input_path),
    "to_text": lambda spark, input_path: spark.read.parquet(input_path),
}


def parameters(args: list[str]) -> dict[str, str]:
    """From ``-key=value`` arguments, or a file of ``name<TAB>value`` lines."""
    if len(args) == 1 and not args[0].startswith("-"):
        return dict(line.split("\t", 1) for line in Path(args[0]).read_text().splitlines() if line.strip())
    return dict(a.lstrip("-").split("=", 1) for a in args)


def run(spark: SparkSession, tool: str, **params) -> DataFrame:
    """The result of a tool; a parameter that is missing or unknown raises."""
    if tool not in TOOLS:
        raise ValueError(f"no tool {tool!r}; there are {', '.join(sorted(TOOLS))}")
    inspect.signature(TOOLS[tool]).bind(spark, **params)
    return TOOLS[tool](spark, **params)


def main(args: list[str]) -> None:
    params = parameters(args[1:])
    path, text = params.pop("output_path"), params.pop("text", "false") == "true" or args[0] == "to_text"
    spark = SparkSession.builder.getOrCreate()
    (writers.tsv if text else writers.table)(run(spark, args[0], **params), path)


if __name__ == "__main__":
    main(sys.argv[1:])
