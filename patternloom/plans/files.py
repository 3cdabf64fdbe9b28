"""Queries that write a table out as files and read it back: sources, sinks, and tools by name."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tools
from ..schema import TOKEN
from ..sources import readers, writers
from . import catalog as c
from . import walks


def _folder(spark) -> str:
    """A new folder in the shared folder."""
    return os.path.join(walks.shared(spark), f"files-{uuid.uuid4().hex}")


def _text(df: DataFrame, path: str, **options) -> str:
    """The one column of df as lines."""
    df.write.options(**options).text(path)
    return path


def _flat(text) -> Column:
    """Text in one line."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t\r\n]+", " ")


_FLAT = r"regexp_replace(coalesce(text, ''), '[\t\r\n]+', ' ', 'g')"
_ID = "CAST(doc_id AS VARCHAR)"


def _lines(spark, d) -> str:
    """documents as lines of id and text."""
    docs = c._t(spark, d, "documents")
    return _text(docs.select(F.concat_ws("\t", F.col("doc_id").cast("string"), _flat(F.col("text"))).alias("value")), _folder(spark))


# ---------------------------------------------------------------- sources


@c.query("source_lines", f"SELECT {_ID} AS docid, {_FLAT} AS content FROM documents")
def source_lines(spark, d):
    return readers.lines(spark, _lines(spark, d))


@c.query(
    "source_line_offsets",
    """WITH o AS (SELECT o_orderkey, o_orderstatus || ' of ' || o_custkey AS content FROM orders),
    p AS (SELECT *, sum(strlen(content) + 1) OVER (ORDER BY o_orderkey) - strlen(content) - 1 AS pos FROM o) SELECT CAST(pos AS BIGINT) AS pos, content FROM p""",
)
def source_line_offsets(spark, d):
    """One file, so that the offsets are known; many lines are equal, their ids aren't."""
    o = c._t(spark, d, "orders").select("o_orderkey", F.concat_ws(" of ", "o_orderstatus", F.col("o_custkey").cast("string")).alias("value"))
    path = _text(o.repartition(1).sortWithinPartitions("o_orderkey").select("value"), _folder(spark))
    return readers.lines(spark, path).select(F.substring_index("docid", ":", -1).cast("long").alias("pos"), "content")


@c.query("source_files", "SELECT md5(html || chr(10)) AS digest, CAST(count(*) AS BIGINT) AS n FROM pages WHERE html IS NOT NULL GROUP BY ALL")
def source_files(spark, d):
    path = _folder(spark)
    c._t(spark, d, "pages").where("html is not null").select("page_id", "html").write.partitionBy("page_id").text(path)
    return readers.whole_files(spark, path).groupBy(F.md5(F.col("content").cast("binary")).alias("digest")).agg(F.count("*").alias("n"))


@c.query("source_trec", f"SELECT {_ID} AS docid, md5('<DOC><DOCNO> ' || doc_id || ' </DOCNO>' || coalesce(text, '') || '</DOC>') AS digest FROM documents WHERE NOT contains(coalesce(text, ''), '</DOC>')")
def source_trec(spark, d):
    docs = c._t(spark, d, "documents").where("not contains(coalesce(text, ''), '</DOC>')")
    value = F.concat(F.lit("<DOC><DOCNO> "), F.col("doc_id").cast("string"), F.lit(" </DOCNO>"), F.coalesce("text", F.lit("")), F.lit("</DOC>"))
    return readers.trec(spark, _text(docs.select(value.alias("value")), _folder(spark))).select("docid", F.md5(F.col("content").cast("binary")).alias("digest"))


@c.query("source_elements", "SELECT md5('<item n=\"' || l_linenumber || '\">' || l_orderkey || chr(10) || l_partkey || '</item>') AS digest, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL")
def source_elements(spark, d):
    """Elements over several lines; a last one without its end is no record."""
    text = lambda n: F.col(n).cast("string")
    item = F.concat(F.lit('noise <item n="'), text("l_linenumber"), F.lit('">'), text("l_orderkey"), F.lit("\n"), text("l_partkey"), F.lit("</item> noise"))
    path = _text(c._t(spark, d, "lineitem").select(item.alias("value")), _folder(spark))
    _text(spark.range(1).select(F.lit("<item>never ended").alias("value")).coalesce(1), os.path.join(path, "unclosed"))
    return readers.elements(spark, path, "<item", "</item>").groupBy(F.md5(F.col("content").cast("binary")).alias("digest")).agg(F.count("*").alias("n"))


@c.query("source_posts", "SELECT CAST(event_id AS VARCHAR) AS docid, event_type || ' User' || user_id AS text, 'Place' || (user_id % 7) AS location FROM events")
def source_posts(spark, d):
    e = c._t(spark, d, "events")
    post = F.struct(
        F.col("event_id").alias("id"),
        F.concat_ws(" ", "event_type", F.concat(F.lit("User"), F.col("user_id"))).alias("text"),
        F.date_format("ts", "EEE MMM dd HH:mm:ss Z yyyy").alias("created_at"),
        F.lit(False).alias("retweeted"),
        F.struct(F.col("user_id").cast("string").alias("screen_name"), F.concat(F.lit("Place"), F.col("user_id") % 7).alias("location")).alias("user"),
    )
    rows = readers.posts(spark, _text(e.select(F.to_json(post).alias("value")), _folder(spark), compression="gzip"))
    return rows.select("docid", "text", "location")


@c.query("source_warc", "SELECT 'page-' || page_id AS docid, 'response' AS record_type, md5(html || 'é') AS digest, CAST(strlen(html) + 2 AS BIGINT) AS length FROM pages WHERE html IS NOT NULL")
def source_warc(spark, d):
    body = F.concat("html", F.lit("é"))
    answer = F.concat(F.lit("HTTP/1.1 200 OK\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\n"), body)
    head = F.concat(F.lit("WARC/0.18\nWARC-Type: response\nWARC-TREC-ID: page-"), F.col("page_id").cast("string"), F.lit("\nContent-Length: "), F.octet_length(answer).cast("string"), F.lit("\n\n"))
    pages = c._t(spark, d, "pages").where("html is not null").select(F.concat(head, answer, F.lit("\n")).alias("value"))
    rows = readers.warc(spark, _text(pages, _folder(spark), compression="gzip"))
    return rows.select("docid", "record_type", F.md5(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").cast("long").alias("length"))


@c.query("source_seeds", "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS context, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS pattern, CAST(c_custkey AS DOUBLE) / 4 AS weight FROM customer")
def source_seeds(spark, d):
    k = F.col("c_custkey")
    value = F.concat_ws("\t", k.cast("string"), F.when(k % 2 == 0, F.col("c_name")).otherwise("*"), F.when(k % 2 == 1, F.col("c_mktsegment")).otherwise("*"), (k / 4).cast("string"))
    return readers.seeds(spark, _text(c._t(spark, d, "customer").select(value.alias("value")), _folder(spark)))


@c.query("source_relation_types", "SELECT 'r' || n_nationkey AS rel_id, n_name AS rel_name, 'who:kb:A:PERSON,' || 'place' || n_regionkey || ':kb:B:ANY' AS args FROM nation")
def source_relation_types(spark, d):
    value = F.concat_ws("\t", F.concat(F.lit("r"), F.col("n_nationkey").cast("string")), "n_name", F.lit("who\tkb:A\tPERSON"), F.concat(F.lit("place"), F.col("n_regionkey").cast("string")), F.lit("kb:B\tANY"))
    rows = readers.relation_types(spark, _text(c._t(spark, d, "nation").select(value.alias("value")), _folder(spark)))
    return rows.select("rel_id", "rel_name", F.array_join(F.transform("args", lambda a: F.concat_ws(":", a["name"], a["type"], a["class"])), ",").alias("args"))


@c.query("source_relation_patterns", "SELECT 'r' || n_regionkey AS name, n_name AS pattern, CASE WHEN n_nationkey % 2 = 0 THEN 1.0::DOUBLE ELSE n_nationkey / 8.0::DOUBLE END AS weight FROM nation")
def source_relation_patterns(spark, d):
    k = F.col("n_nationkey")
    value = F.concat_ws("\t", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "n_name", F.when(k % 2 == 1, (k / 8).cast("string")))
    return readers.relation_patterns(spark, _text(c._t(spark, d, "nation").select(value.alias("value")), _folder(spark)))


@c.query("source_regex_list", "SELECT '^' || n_name || '$' AS pattern, n_name AS sentence FROM nation")
def source_regex_list(spark, d):
    n = c._t(spark, d, "nation")
    found = readers.regex_list(spark, _text(n.select(F.concat(F.lit("^"), "n_name", F.lit("$")).alias("value")), _folder(spark)))
    return tools.mine.pattern_sentences(n.select(F.col("n_name").alias("sentence")), found)


# ---------------------------------------------------------------- sinks


@c.query("sink_table", "SELECT doc_id, source, lang, n_chars FROM documents")
def sink_table(spark, d):
    path = _folder(spark)
    writers.table(c._t(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), path)
    return spark.read.parquet(path)


@c.query("sink_text", f"SELECT {_ID} || chr(9) || {_FLAT} || chr(9) || coalesce(source, '') AS line FROM documents")
def sink_text(spark, d):
    path = _folder(spark)
    empty = lambda x: F.coalesce(x, F.lit(""))
    writers.tsv(c._t(spark, d, "documents").select("doc_id", _flat(F.col("text")).alias("text"), empty("source").alias("source")), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> '')"


def _annotated(spark, d) -> DataFrame:
    """documents with a token for each run of letters: its tag by a fixed rule on its last letter and length, and its head
    the token before it, so that SQL can make the same annotation."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda x: x != "")
    last = lambda w: F.right(w, F.lit(1))
    pos = lambda w: F.when(last(w).isin("e", "s"), "NN").when(last(w).isin("d", "n"), "VBD").when(last(w) == "t", "IN").otherwise("JJ")
    none = F.lit(None).cast("string")
    token = lambda w, i: F.struct(
        w.alias("token"), i.alias("begin"), (i + 1).alias("end"), w.alias("lemma"), pos(w).alias("pos"), F.concat(F.lit("B-"), F.substr(pos(w), F.lit(1), F.lit(2))).alias("chunk"), F.lit("O").alias("ne"), F.when(i == 0, "root").otherwise("dep").alias("dep_type"), i.alias("dep_index"), F.lit(-1).alias("coref_id")
    )
    docs = c._t(spark, d, "documents")
    kept = F.when(F.size(words) > 0, F.array(F.transform(words, token))).otherwise(F.array().cast(f"array<array<{TOKEN}>>"))
    return docs.select(F.col("doc_id").cast("string").alias("docid"), kept.cast(f"array<array<{TOKEN}>>").alias("sentences"))


def _annotated_counts(spark, d, extract, *args) -> DataFrame:
    return tools.ex.pair_counts(extract(_annotated(spark, d), *args, counts=True), whole=not tools.ex.repeats(c._t(spark, d, "documents").select("doc_id")))


_POS = "CASE WHEN right(x, 1) IN ('e', 's') THEN 'NN' WHEN right(x, 1) IN ('d', 'n') THEN 'VBD' WHEN right(x, 1) = 't' THEN 'IN' ELSE 'JJ' END"


@c.query("sink_parsed", f"SELECT {_ID} AS docid, CAST(len({_WORDS}) AS BIGINT) AS n_tokens, md5(array_to_string(list_transform({_WORDS}, lambda x: x || '/' || {_POS}), ' ')) AS digest FROM documents")
def sink_parsed(spark, d):
    path = _folder(spark)
    writers.parsed(_annotated(spark, d), path)
    tokens = F.flatten("sentences")
    docs = readers.parsed(spark, path)
    text = F.array_join(F.transform(tokens, lambda t: F.concat_ws("/", t["token"], t["pos"])), " ")
    return docs.select("docid", F.size(tokens).cast("long").alias("n_tokens"), F.md5(text.cast("binary")).alias("digest"))


@c.query("parsed_signatures", f"SELECT {_ID} AS docid, array_to_string(list_transform({_WORDS}, lambda x: CASE WHEN x = 'and' THEN 'C' ELSE CASE {_POS} WHEN 'NN' THEN 'N' WHEN 'VBD' THEN 'O' WHEN 'IN' THEN 'P' ELSE 'A' END END), '') AS signature FROM documents WHERE len({_WORDS}) > 0")
def parsed_signatures(spark, d):
    rows = _annotated(spark, d).select("docid", F.explode("sentences").alias("tokens"))
    return rows.select("docid", tools.nlp.signature_column(F.col("tokens")).alias("signature"))


_WORD_ROWS = f"""d AS (SELECT {_ID} AS docid, {_WORDS} AS w FROM documents),
  t AS (SELECT docid, i, w[i] AS x, {_POS.replace('right(x,', 'right(w[i],')} AS pos, CASE WHEN i > 1 THEN w[i - 1] END AS p, CASE WHEN i > 2 THEN w[i - 2] END AS pp, CASE WHEN i < len(w) THEN w[i + 1] END AS n
    FROM (SELECT docid, w, unnest(range(1, len(w) + 1)) AS i FROM d))"""


@c.query(
    "parsed_chunk_pairs",
    f"""WITH {_WORD_ROWS}, q AS (
      SELECT docid, unnest([{{'a': p, 'b': x, 'm': p || '|_|'}}, {{'a': p, 'b': x, 'm': '|_|' || x}}], recursive := true) FROM t WHERE p IS NOT NULL
      UNION ALL SELECT docid, p, n, x FROM t WHERE p IS NOT NULL AND n IS NOT NULL),
    r AS (SELECT docid, a || '|' || b AS context, m AS pattern FROM q UNION ALL SELECT docid, b || '|' || a, '|-' || m FROM q)
    SELECT docid, context, pattern, CAST(count(*) AS BIGINT) AS matches FROM r GROUP BY ALL""",
)
def parsed_chunk_pairs(spark, d):
    return _annotated_counts(spark, d, tools.nlp.extract_chunks, True, 0, "l*r")


@c.query(
    "parsed_nary_chunks",
    f"""WITH {_WORD_ROWS}, k AS (SELECT *, left(pos, 2) AS ty, lag(left(pos, 2)) OVER o AS ty1, lag(left(pos, 2), 2) OVER o AS ty2 FROM t WINDOW o AS (PARTITION BY docid ORDER BY i)),
    q AS (SELECT docid, p AS a, x AS b, ty1 || '||_||' || ty || '|' AS m FROM k WHERE p IS NOT NULL
      UNION ALL SELECT docid, pp, x, ty2 || '|*|' || ty || '|' FROM k WHERE pp IS NOT NULL
      UNION ALL SELECT docid, pp, x, ty2 || '|' || p || '|' || ty || '|' FROM k WHERE pp IS NOT NULL),
    r AS (SELECT docid, a || '|' || b AS context, m || '1/2' AS pattern FROM q UNION ALL SELECT docid, b || '|' || a, m || '0/2' FROM q)
    SELECT docid, context, pattern, CAST(count(*) AS BIGINT) AS matches FROM r GROUP BY ALL""",
)
def parsed_nary_chunks(spark, d):
    return _annotated_counts(spark, d, tools.nlp.extract_nary, 2, 0)


_HEAD = _POS.replace("right(x,", "right(p,")
_HEAD2 = _POS.replace("right(x,", "right(pp,")


@c.query(
    "parsed_graph",
    f"""WITH {_WORD_ROWS}, e AS (SELECT x AS term, pos, p IS NULL OR ({_HEAD} = 'IN' AND pp IS NULL) AS top, p IS NOT NULL AND {_HEAD} = 'IN' AS over, p, pp FROM t)
    SELECT term, CASE WHEN top THEN '{{root}}' WHEN over THEN pp ELSE p END AS head, pos, CASE WHEN top THEN '{{root}}' WHEN over THEN {_HEAD2} ELSE {_HEAD} END AS head_pos,
      CASE WHEN p IS NULL THEN 'root' WHEN over THEN 'dep_IN' ELSE 'dep' END AS dep_type, CAST(count(*) AS BIGINT) AS count FROM e GROUP BY ALL""".replace("{root}", tools.nlp.ROOT),
)
def parsed_graph(spark, d):
    return tools.nlp.parse_graph(_annotated(spark, d))


@c.query("sink_documents_xml", f"SELECT {_ID} || chr(9) || '<doc>' || replace(replace(replace({_FLAT}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</doc>' AS line FROM documents")
def sink_documents_xml(spark, d):
    path = _folder(spark)
    text = _flat(F.col("text"))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    writers.documents_xml(c._t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("docid"), F.concat(F.lit("<doc>"), text, F.lit("</doc>")).alias("xml")), path, 4)
    return spark.read.text(path).withColumnRenamed("value", "line")


# ---------------------------------------------------------------- tools over files

_TAGGED = f"toks AS (SELECT {_ID} AS docid, {c._tag_sql(_FLAT)} AS tk FROM documents), pairs AS (SELECT docid, {c._LR} FROM toks)"
_FEW = "VALUES ('1', 'the|of', 2.0::DOUBLE), ('1', 'of|and', 1.0::DOUBLE), ('2', 'and|the', 3.0::DOUBLE), ('2', 'the|of', 1.0::DOUBLE), ('2', 'never|seen', 1.0::DOUBLE)"
_FILE_SEEDS = f"seeds AS (SELECT * FROM ({_FEW}) AS t(id, context, weight))"
_NGRAM = {"corpus_class": "lines", "extractor_class": "ngram", "extractor_args": "1:1:1:0:l*r"}


def _seed_file(spark) -> str:
    rows = spark.sql(f"SELECT * FROM {_FEW.replace('::DOUBLE', 'D')} AS t(id, context, weight)")
    return _text(rows.select(F.concat_ws("\t", "id", "context", F.lit("*"), F.col("weight").cast("string")).alias("value")), _folder(spark))


def _table(spark, df: DataFrame) -> str:
    path = _folder(spark)
    writers.table(df, path)
    return path


_T_HOP = f"WITH {_TAGGED}, {_FILE_SEEDS}, {c._hop_sql('cp', 'seeds', 'context')}"


@c.query("tool_context_to_pattern", f"{_T_HOP} SELECT {c._STATS_COLUMNS} FROM cp")
def tool_context_to_pattern(spark, d):
    return c._stats_out(tools.run(spark, "context_to_pattern", seeds_path=_seed_file(spark), corpus_path=_lines(spark, d), **_NGRAM))


@c.query(
    "tool_extract",
    f"""{_T_HOP} SELECT id, context, pattern, matches, CAST(0 AS BIGINT) AS global_pattern_count, global_context_count, weight FROM cp
    UNION ALL SELECT id, context, NULL, 0, 0, 0, weight FROM seeds WHERE context NOT IN (SELECT context FROM pairs)""",
)
def tool_extract(spark, d):
    """Seeds without a match have a row too."""
    return tools.run(spark, "extract", seeds_path=_seed_file(spark), corpus_path=_lines(spark, d), keep_unmatched=True, **_NGRAM)


@c.query("tool_extract_global_stats", f"{_T_HOP} SELECT pattern, CAST(g AS BIGINT) AS count, CAST((SELECT count(*) FROM pairs) AS BIGINT) AS total FROM cp_g")
def tool_extract_global_stats(spark, d):
    corpus = _lines(spark, d)
    stats = tools.run(spark, "extract", seeds_path=_seed_file(spark), corpus_path=corpus, **_NGRAM)
    return tools.run(spark, "extract_global_stats", input_path=_table(spark, stats), corpus_path=corpus, **_NGRAM)


@c.query("tool_combine_splits", f"{_T_HOP} SELECT {c._STATS_COLUMNS} FROM cp")
def tool_combine_splits(spark, d):
    """extract, extract_global_stats and combine_splits by files give what one walk gives."""
    corpus = _lines(spark, d)
    stats = _table(spark, tools.run(spark, "extract", seeds_path=_seed_file(spark), corpus_path=corpus, **_NGRAM))
    counts = _table(spark, tools.run(spark, "extract_global_stats", input_path=stats, corpus_path=corpus, **_NGRAM))
    return c._stats_out(tools.run(spark, "combine_splits", input_path=stats, counts_path=counts))


@c.query("tool_score_patterns", f"{_T_HOP}, {c._score_sql('pmi', 'cp', 'o', 'pattern')} SELECT id, pattern, CASE WHEN round(score, 6) = 0 THEN 0.0::DOUBLE ELSE round(score, 6) END AS score FROM o")
def tool_score_patterns(spark, d):
    corpus = _lines(spark, d)
    stats = _table(spark, tools.run(spark, "context_to_pattern", seeds_path=_seed_file(spark), corpus_path=corpus, **_NGRAM))
    counts = _table(spark, tools.run(spark, "extract_global_stats", input_path=stats, corpus_path=corpus, **_NGRAM))
    return c._round(tools.run(spark, "score_patterns", input_path=stats, scorer_class="pmi", scorer_args="pmi", total=counts))


@c.query(
    "tool_compute_context_scores",
    f"{_T_HOP}, {c._project_sql('s2', 'cp', 'pattern')}, {c._hop_sql('h2', 's2', 'pattern')}, {c._score_sql('likelihood', 'cp', 'ps', 'pattern')}, u AS (SELECT h2.id, h2.context, h2.pattern, h2.matches, h2.global_pattern_count, h2.global_context_count, ps.score AS weight FROM h2 JOIN ps USING (id, pattern)), {c._score_sql('likelihood', 'u', 'o', 'context')} SELECT id, context, round(score, 6) AS score FROM o",
)
def tool_compute_context_scores(spark, d):
    return c._round(tools.run(spark, "compute_context_scores", seeds_path=_seed_file(spark), corpus_path=_lines(spark, d), scorer_class="likelihood", other_scorer_class="likelihood", **_NGRAM))


@c.query("tool_combine_stats", f"{_T_HOP} SELECT id, context, pattern, CAST(CASE WHEN context = 'the|of' THEN 2 * matches ELSE matches END AS BIGINT) AS matches, CAST(CASE WHEN context = 'the|of' THEN 2 * global_pattern_count ELSE global_pattern_count END AS BIGINT) AS global_pattern_count, CAST(CASE WHEN context = 'the|of' THEN 2 * global_context_count ELSE global_context_count END AS BIGINT) AS global_context_count, round(weight, 6) AS weight FROM cp")
def tool_combine_stats(spark, d):
    stats = _table(spark, tools.run(spark, "context_to_pattern", seeds_path=_seed_file(spark), corpus_path=_lines(spark, d), **_NGRAM))
    some = _table(spark, spark.read.parquet(stats).where("context = 'the|of'"))
    return c._stats_out(tools.run(spark, "combine_stats", input_path=f"{stats},{some}"))


@c.query("tool_harvest_pairs", f"WITH {_TAGGED} SELECT docid, context, pattern, CAST(count(*) AS BIGINT) AS matches FROM pairs GROUP BY ALL HAVING count(*) >= 2")
def tool_harvest_pairs(spark, d):
    return tools.run(spark, "context_pattern_pairs", corpus_path=_lines(spark, d), min_matches=2, **_NGRAM)


@c.query("tool_examples", f"SELECT id, context, CAST(NULL AS VARCHAR) AS pattern, weight FROM ({_FEW}) AS t(id, context, weight)")
def tool_examples(spark, d):
    return tools.run(spark, "examples", input_path=_seed_file(spark))


@c.query(
    "parsed_paths",
    """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS docid, 'Cust' || o_custkey AS a, 'Status' || o_orderstatus AS b FROM orders)
    SELECT docid, a || '|' || b AS context, 'NP|nsubj|VB|ordered|VB|dobj|NP' AS pattern, CAST(1 AS BIGINT) AS matches FROM o
    UNION ALL SELECT docid, b || '|' || a, 'NP|dobj|VB|ordered|VB|nsubj|NP', CAST(1 AS BIGINT) FROM o""",
)
def parsed_paths(spark, d):
    """Dependency paths of a sentence for each order: "Cust7 ordered StatusF", both nouns under the verb."""
    rows = c._t(spark, d, "orders")

    def token(word, k, pos, chunk, dep, head):
        return F.struct(
            word.alias("token"), F.lit(k).alias("begin"), F.lit(k + 1).alias("end"), word.alias("lemma"), F.lit(pos).alias("pos"), F.lit(chunk).alias("chunk"), F.lit("O").alias("ne"), F.lit(dep).alias("dep_type"), F.lit(head).alias("dep_index"), F.lit(-1).alias("coref_id")
        )

    words = (F.concat(F.lit("Cust"), F.col("o_custkey").cast("string")), F.lit("ordered"), F.concat(F.lit("Status"), F.col("o_orderstatus")))
    tokens = [token(w, k, *x) for k, (w, x) in enumerate(zip(words, (("NN", "B-NP", "nsubj", 2), ("VBD", "B-VP", "root", 0), ("NN", "B-NP", "dobj", 2)), strict=True))]
    docs = rows.select(F.col("o_orderkey").cast("string").alias("docid"), F.array(F.array(*tokens)).cast(f"array<array<{TOKEN}>>").alias("sentences"))
    return tools.ex.pair_counts(tools.nlp.extract_paths(docs, counts=True))
