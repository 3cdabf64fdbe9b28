"""The queries of the engine, and the SQL that gives the same rows.

Pairs come from white-space tokens of ``documents`` unless a query says
otherwise.  Seeds are derived from the corpus (its most frequent contexts or
patterns), so every query runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import collections as coll
from ..functions import formats as fmt
from ..functions.nlp import annotate, extract_chunks, extract_nary, extract_paths, parse_graph, signature_column, spread
from ..functions.tokenize import PTB_RULES, PUNCTUATION, SPLIT, ngrams, ptb_tokens, sentences, tag_tokens, whitespace_tokens
from ..operators import extract as ex
from ..operators import score as sc
from ..operators import stats as st
from . import instances, mine, relations, walks


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d) -> DataFrame:
    return ex.tokenized(_t(spark, d, "documents"))


def _whole(spark, d) -> bool:
    """Whether each document is one row, so that its pairs can be counted without a shuffle."""
    return not ex.repeats(_t(spark, d, "documents").select("doc_id"))


def _pairs(spark, d, style: str = "l*r") -> DataFrame:
    return ex.ngram_pairs(_docs(spark, d), style=style)


# ---------------------------------------------------------------- SQL pieces

_TOK = r"list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')"
_DOCS = f"toks AS (SELECT CAST(doc_id AS VARCHAR) AS docid, {_TOK} AS tk FROM documents)"
_LR = "unnest(list_transform(range(2, len(tk)), lambda i: {'context': tk[i-1] || '|' || tk[i+1], 'pattern': tk[i]}), recursive := true)"
_L = "unnest(list_transform(range(2, len(tk) + 1), lambda i: {'context': tk[i-1] || '|*', 'pattern': tk[i]}), recursive := true)"
_R = "unnest(list_transform(range(1, len(tk)), lambda i: {'context': '*|' || tk[i+1], 'pattern': tk[i]}), recursive := true)"
_PAIRS = f"{_DOCS}, pairs AS (SELECT docid, {_LR} FROM toks)"


def _ngrams(tk: str, n: int) -> str:
    parts = [f"list_transform(range(1, greatest(len({tk}) - {k - 2}, 1)), lambda i: array_to_string({tk}[i:i+{k - 1}], ' '))" for k in range(1, n + 1)]
    return f"flatten([{', '.join(parts)}])"


def _seed_sql(side: str, k: int) -> str:
    return f"""ranked AS (SELECT {side}, n, row_number() OVER (ORDER BY n DESC, {side}) AS r FROM (SELECT {side}, count(*) AS n FROM pairs GROUP BY {side}) ORDER BY r LIMIT {k + 10}),
      seeds AS (SELECT '1' AS id, {side}, CAST(n AS DOUBLE) AS weight FROM ranked WHERE r <= {k} UNION ALL SELECT '2', {side}, n / 2.0::DOUBLE FROM ranked WHERE r > 10)"""


def _seeds(pairs: DataFrame, side: str, k: int) -> DataFrame:
    """Seeds of two ids: the k most frequent values of a side, weighted by frequency; those from the eleventh to ten
    after the last, with half the weight."""
    top = pairs.groupBy(side).agg(F.sum("matches").alias("n")).orderBy(F.desc("n"), side).limit(k + 10)
    place = F.row_number().over(Window.orderBy(F.desc("n"), side))  # of k + 10 rows
    top = walks.settle(top.withColumn("r", place), "seeds")
    weight = F.col("n").cast("double")
    return top.where(F.col("r") <= k).select(F.lit("1").alias("id"), side, weight.alias("weight")).unionByName(top.where("r > 10").select(F.lit("2").alias("id"), side, (weight / 2).alias("weight")))


def _counted(spark, d) -> DataFrame:
    """All pairs, counted once for all steps of a query."""
    return walks.settled(_pairs(spark, d))


_SEEDS = 50


def _hop_sql(name: str, seeds: str, side: str) -> str:
    far = st.other(side)
    return f"""{name}_m AS (SELECT s.id, p.context, p.pattern, count(*) AS matches, max(s.weight) AS weight
        FROM pairs p JOIN {seeds} s ON p.{side} = s.{side} GROUP BY ALL),
      {name}_g AS (SELECT {far}, count(*) AS g FROM pairs WHERE {far} IN (SELECT {far} FROM {name}_m) GROUP BY {far}),
      {name} AS (SELECT m.id, m.context, m.pattern, CAST(m.matches AS BIGINT) AS matches, CAST(g.g AS BIGINT) AS global_{far}_count,
        CAST(sum(m.matches) OVER (PARTITION BY m.id, m.{side}) AS BIGINT) AS global_{side}_count, m.weight
        FROM {name}_m m JOIN {name}_g g ON m.{far} = g.{far})"""


def _project_sql(name: str, rows: str, side: str) -> str:
    return f"{name} AS (SELECT id, {side}, sum(weight) AS weight FROM {rows} GROUP BY id, {side})"


_STATS_COLUMNS = "id, context, pattern, matches, global_pattern_count, global_context_count, round(weight, 6) AS weight"
_C2P = f"WITH {_PAIRS}, {_seed_sql('context', _SEEDS)}, {_hop_sql('cp', 'seeds', 'context')}"
_P2C = f"WITH {_PAIRS}, {_seed_sql('pattern', _SEEDS)}, {_hop_sql('pc', 'seeds', 'pattern')}"


def _c2p(spark, d, k: int = _SEEDS):
    pairs = _counted(spark, d)
    return pairs, walks.context_to_pattern(pairs, _seeds(pairs, "context", k))


def _p2c(spark, d, k: int = _SEEDS):
    pairs = _counted(spark, d)
    return pairs, walks.pattern_to_context(pairs, _seeds(pairs, "pattern", k))


def _stats_out(df: DataFrame) -> DataFrame:
    return df.select("id", "context", "pattern", "matches", "global_pattern_count", "global_context_count", F.round("weight", 6).alias("weight"))


def _round(df: DataFrame, column: str = "score", places: int = 6) -> DataFrame:
    return df.withColumn(column, F.round(column, places))


_N = "(SELECT count(*) FROM pairs)"
#: row score, static, final in SQL, for a side and its opposite side
_SCORERS = {
    "pmi": ("pmi", "pmi", "weight * ln(matches * {N}::DOUBLE / (global_pattern_count * global_context_count::DOUBLE))", "0", "s / w"),
    "emim": ("pmi", "emim", "weight * matches / {N} * ln(matches * {N}::DOUBLE / (global_pattern_count * global_context_count::DOUBLE))", "0", "s / w"),
    "pmi_smoothed": ("pmi", "pmi:1", "weight * ln(matches * {N}::DOUBLE / ((global_pattern_count + 1.0::DOUBLE) * (global_context_count + 1.0::DOUBLE)))", "0", "s / w"),
    "likelihood": ("likelihood", None, "weight * matches / global_{far}_count", "0", "s / w"),
    "tfidf_binary": ("tfidf", "binary:idf", "weight * ln({N}::DOUBLE / global_{side}_count)", "0", "s / w"),
    "tfidf_tf": ("tfidf", "tf:none", "weight * matches", "0", "s / w"),
    "tfidf_log": ("tfidf", "log:idf", "weight * ln(matches + 1.0::DOUBLE) * ln({N}::DOUBLE / global_{side}_count)", "0", "s / w"),
    "tfidf_okapi": ("tfidf", "okapi:okapi", "weight * (matches * 2.75::DOUBLE / (matches + 1.75::DOUBLE)) * ln(({N} - global_{side}_count + 0.5::DOUBLE) / (global_{side}_count + 0.5::DOUBLE))", "0", "s / w"),
    "fmeasure": ("fmeasure", "0.5", "weight", "global_{side}_count", "n * (s / w) / (0.5::DOUBLE * static + 0.5::DOUBLE * n)"),
}


def _score_sql(name: str, stats: str, out: str, side: str) -> str:
    _, _, row, static, final = _SCORERS[name]
    far = st.other(side)
    f = {"N": _N, "side": side, "far": far}
    return f"""{out}_w AS (SELECT id, count(*)::DOUBLE AS n, sum(w) AS w FROM (SELECT id, {far}, max(weight) AS w FROM {stats} GROUP BY ALL) GROUP BY id),
      {out}_s AS (SELECT id, {side}, sum({row.format(**f)}) AS s, max({static.format(**f)}) AS static FROM {stats} GROUP BY ALL),
      {out} AS (SELECT id, {side}, {final} AS score FROM {out}_s JOIN {out}_w USING (id))"""


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- tokens and pairs


@query(
    "top_ngrams_per_document",
    f"""WITH {_DOCS}, p AS (SELECT docid, unnest({_ngrams('tk', 2)}) AS pattern FROM toks), c AS (SELECT docid, pattern, count(*) AS matches FROM p GROUP BY ALL)
    SELECT docid, pattern, CAST(matches AS BIGINT) AS matches FROM c QUALIFY row_number() OVER (PARTITION BY docid ORDER BY matches DESC, pattern) <= 10""",
)
def top_ngrams_per_document(spark, d):
    docs = _docs(spark, d)
    if _whole(spark, d):
        return ex.top_within(docs, ngrams("tokens", 2), 10)
    counts = ex.counts_within(docs, ex.cooccurrence_array(2), False)
    top = sc.top_results(counts.select(F.col("docid").alias("id"), "pattern", F.col("matches").alias("score")), 10, ("pattern",), summed=True)
    return top.select(F.col("id").alias("docid"), "pattern", F.col("score").alias("matches"))


@query("tokenize_ws", f"SELECT doc_id, array_to_string({_TOK}, ' ') AS tokens, CAST(len({_TOK}) AS BIGINT) AS n FROM documents")
def tokenize_ws(spark, d):
    t = whitespace_tokens("text")
    return _t(spark, d, "documents").select("doc_id", F.array_join(t, " ").alias("tokens"), F.size(t).cast("long").alias("n"))


_S, _P = SPLIT, PUNCTUATION


def _tag_sql(text: str) -> str:
    x = f"coalesce({text}, '')"
    for a, b in ((r"(?s)<!--.*?(?:-->|$)", " "), (r"(?is)<script\b.*?(?:</script\s*>|$)", " "), (r"(?is)<style\b.*?(?:</style\s*>|$)", " "), (r"(?s)<[?!].*?>", " "), (r"(?s)<[/a-zA-Z][^>]*>", " "), (r"&[a-z0-9#]*;", "& ")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    found = f"regexp_extract_all({x}, '([^{_S}.]*\\.[^{_S}]*[{_P}]?|[^{_S}]+|[{_P}])', 1)"
    word = "lower(replace(r, '''', ''))"
    body = f"regexp_replace({word}, '[{_P}]$', '')"
    core = f"trim({body}, '.')"
    fixed = f"""CASE WHEN NOT contains(r, '.') THEN [{word}]
      WHEN NOT contains({core}, '.') THEN list_filter([CASE WHEN starts_with({body}, '.') THEN '.' END, {core}, CASE WHEN ends_with({body}, '.') AND {core} <> '' THEN '.' END], lambda y: y IS NOT NULL)
      WHEN regexp_full_match({core}, '(?:[^.]\\.)+[^.]') THEN [replace({core}, '.', '')]
      ELSE list_filter(string_split({core}, '.'), lambda y: length(y) > 1) END"""
    return f"list_filter(flatten(list_transform({found}, lambda r: {fixed})), lambda y: y <> '' AND strlen(y) < 100)"


@query("tokenize_tag", f"SELECT page_id, array_to_string({_tag_sql('html')}, ' ') AS tokens FROM pages")
def tokenize_tag(spark, d):
    return _t(spark, d, "pages").select("page_id", F.array_join(tag_tokens("html"), " ").alias("tokens"))


def _ptb_sql() -> str:
    x = "coalesce(text, '')"
    for pattern, to in PTB_RULES:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to.replace('$', chr(92)).replace(chr(39), chr(39) * 2)}', 'g')"
    return f"list_filter(string_split_regex({x}, ' +'), lambda y: y <> '')"


@query("tokenize_ptb", f"SELECT conv_id, turn, array_to_string({_ptb_sql()}, ' ') AS tokens FROM conversations")
def tokenize_ptb(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.array_join(ptb_tokens("text"), " ").alias("tokens"))


_SENT = r"list_filter(string_split(regexp_replace(replace(coalesce(text, ''), chr(10), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


@query("sentence_split", f"SELECT doc_id, CAST(len({_SENT}) AS BIGINT) AS n, md5(array_to_string({_SENT}, chr(1))) AS digest FROM documents")
def sentence_split(spark, d):
    s = sentences("text")
    return _t(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "\x01").cast("binary")).alias("digest"))


def _pair_query(name: str, style: str, sql: str) -> None:
    @query(name, f"WITH {_DOCS}, pairs AS ({sql}) SELECT context, pattern, CAST(count(*) AS BIGINT) AS matches FROM pairs GROUP BY ALL")
    def run(spark, d):
        return _pairs(spark, d, style).groupBy("context", "pattern").agg(F.count("*").alias("matches"))


_pair_query("ngram_pairs_lstar_r", "l*r", f"SELECT {_LR} FROM toks")
_pair_query("ngram_pairs_l_plus_r", "l+r", f"SELECT {_L} FROM toks UNION ALL SELECT {_R} FROM toks")
_pair_query("ngram_pairs_l", "l", f"SELECT {_L} FROM toks")
_pair_query("ngram_pairs_r", "r", f"SELECT {_R} FROM toks")


@query("cooccur_pairs", f"WITH toks AS (SELECT doc_id, {_tag_sql('text')} AS tk FROM documents), p AS (SELECT CAST(doc_id AS VARCHAR) AS context, unnest({_ngrams('tk', 2)}) AS pattern FROM toks) SELECT context, pattern, CAST(count(*) AS BIGINT) AS matches FROM p GROUP BY ALL")
def cooccur_pairs(spark, d):
    docs = ex.tokenized(_t(spark, d, "documents"), "tag")
    return ex.counts_within(docs, ex.cooccurrence_array(2), _whole(spark, d)).select("context", "pattern", "matches")


def _posts(spark, d) -> DataFrame:
    """events as JSON posts."""
    e = _t(spark, d, "events")
    post = F.struct(
        F.col("event_id").alias("id"),
        F.concat_ws(" ", "event_type", F.concat(F.lit("User"), F.col("user_id"))).alias("text"),
        F.date_format("ts", "EEE MMM dd HH:mm:ss Z yyyy").alias("created_at"),
        F.lit(False).alias("retweeted"),
        F.struct(F.col("user_id").cast("string").alias("screen_name"), F.concat(F.lit("Place"), F.col("user_id") % 7).alias("location")).alias("user"),
    )
    return ex.parse_posts(e.select(F.to_json(post).alias("value")))


_POSTS = "posts AS (SELECT CAST(event_id AS VARCHAR) AS docid, [event_type, 'user' || user_id] AS tk, lower('Place' || (user_id % 7)) AS place, date_trunc('second', ts) AS ts FROM events)"
_DAY = "year(tm) || ':' || month(tm) || ':' || day(tm)"


@query("tweet_cooccur", f"WITH {_POSTS} SELECT docid, docid AS context, unnest({_ngrams('tk', 2)}) AS pattern FROM posts")
def tweet_cooccur(spark, d):
    return ex.post_cooccurrence(_posts(spark, d), 2)


_AROUND = "ats AS (SELECT docid, tk, place, ts + to_hours(CAST(unnest([-1, 0, 1]) AS INTEGER)) AS tm FROM posts)"


@query("tweet_temporal", f"WITH {_POSTS}, {_AROUND}, p AS (SELECT {_DAY} || ':' || hour(tm) AS context, unnest({_ngrams('tk', 2)}) AS pattern FROM ats) SELECT context, pattern, CAST(count(*) AS BIGINT) AS matches FROM p GROUP BY ALL")
def tweet_temporal(spark, d):
    return ex.geo_temporal_pairs(_posts(spark, d), 2, "hour", 1, 1).groupBy("context", "pattern").agg(F.count("*").alias("matches"))


@query("tweet_geo", f"WITH {_POSTS}, p AS (SELECT place AS context, unnest({_ngrams('tk', 1)}) AS pattern FROM posts) SELECT context, pattern, CAST(count(*) AS BIGINT) AS matches FROM p GROUP BY ALL")
def tweet_geo(spark, d):
    return ex.geo_temporal_pairs(_posts(spark, d), 1, geo=True, temporal=False).groupBy("context", "pattern").agg(F.count("*").alias("matches"))


@query("tweet_geo_temporal", f"WITH {_POSTS}, ats AS (SELECT *, ts AS tm FROM posts), p AS (SELECT {_DAY} || '|' || place AS context, unnest({_ngrams('tk', 1)}) AS pattern FROM ats) SELECT context, pattern, CAST(count(*) AS BIGINT) AS matches FROM p GROUP BY ALL")
def tweet_geo_temporal(spark, d):
    return ex.geo_temporal_pairs(_posts(spark, d), 1, "day", geo=True).groupBy("context", "pattern").agg(F.count("*").alias("matches"))


def _talks(spark, d) -> DataFrame:
    """Conversations as documents, a turn being a sentence."""
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.select(F.col("conv_id").cast("string").alias("docid"), F.col("t.text").alias("sentences"))


_PASSAGES = f"""turns AS (SELECT CAST(conv_id AS VARCHAR) AS docid, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, {_TOK} AS tk FROM conversations),
  centres AS (SELECT docid, i AS c FROM turns WHERE i < n - 1)"""


@query(
    "passage_pairs",
    f"""WITH {_PASSAGES}, p AS (SELECT c.docid, c.docid || '|' || c.c AS context, t.tk FROM centres c JOIN turns t ON t.docid = c.docid AND t.i BETWEEN c.c - 1 AND c.c + 1),
    q AS (SELECT docid, context, unnest(tk) AS pattern FROM p) SELECT docid, context, pattern, CAST(count(*) AS BIGINT) AS matches FROM q GROUP BY ALL""",
)
def passage_pairs(spark, d):
    return ex.pair_counts(ex.passage_pairs(_talks(spark, d), lambda w: ex.cooccurrence_pairs(w, 1), 1, 1))


@query("multi_pairs", f"WITH {_DOCS}, p AS (SELECT docid, docid AS context, unnest(tk) AS pattern FROM toks UNION ALL SELECT docid, {_LR} FROM toks) SELECT docid, context, pattern, CAST(count(*) AS BIGINT) AS matches FROM p GROUP BY ALL")
def multi_pairs(spark, d):
    return ex.counts_within(_docs(spark, d), F.concat(ex.cooccurrence_array(1), ex.ngram_array()), _whole(spark, d))


@query("pair_counts", f"WITH {_PAIRS} SELECT docid, context, pattern, CAST(count(*) AS BIGINT) AS matches FROM pairs GROUP BY ALL HAVING count(*) >= 2")
def pair_counts(spark, d):
    return ex.pair_counts(ex.counts_within(_docs(spark, d), ex.ngram_array(), _whole(spark, d)), 2, whole=True)


# ---------------------------------------------------------------- statistics and walks


@query("context_to_pattern", f"{_C2P} SELECT {_STATS_COLUMNS} FROM cp")
def context_to_pattern(spark, d):
    return _stats_out(_c2p(spark, d)[1])


@query("pattern_to_context", f"{_P2C} SELECT {_STATS_COLUMNS} FROM pc")
def pattern_to_context(spark, d):
    return _stats_out(_p2c(spark, d)[1])


@query("context_to_context", f"{_C2P}, {_project_sql('s2', 'cp', 'pattern')}, {_hop_sql('h2', 's2', 'pattern')} SELECT {_STATS_COLUMNS} FROM h2")
def context_to_context(spark, d):
    pairs = _counted(spark, d)
    return _stats_out(walks.context_to_context(pairs, _seeds(pairs, "context", _SEEDS))[1])


@query("pattern_to_pattern", f"{_P2C}, {_project_sql('s2', 'pc', 'context')}, {_hop_sql('h2', 's2', 'context')} SELECT {_STATS_COLUMNS} FROM h2")
def pattern_to_pattern(spark, d):
    pairs = _counted(spark, d)
    return _stats_out(walks.pattern_to_pattern(pairs, _seeds(pairs, "pattern", _SEEDS))[1])


@query("extract_min_matches", f"WITH {_PAIRS}, {_seed_sql('context', _SEEDS)}, m AS (SELECT s.id, p.context, p.pattern, count(*) AS matches, sum(count(*)) OVER (PARTITION BY s.id, p.context) AS g FROM pairs p JOIN seeds s ON p.context = s.context GROUP BY s.id, p.context, p.pattern) SELECT id, context, pattern, CAST(matches AS BIGINT) AS matches, CAST(g AS BIGINT) AS global_context_count FROM m WHERE matches >= 2")
def extract_min_matches(spark, d):
    pairs = _counted(spark, d)
    return st.extract(pairs, _seeds(pairs, "context", _SEEDS), "context", 2).select("id", "context", "pattern", "matches", "global_context_count")


@query("global_stats", f"{_C2P} SELECT pattern, CAST(g AS BIGINT) AS count, CAST({_N} AS BIGINT) AS total FROM cp_g")
def global_stats(spark, d):
    pairs, stats = _c2p(spark, d)
    return st.global_counts(pairs, stats, "pattern").crossJoin(F.broadcast(st.total_pairs(pairs)))


@query("split_weights", f"{_C2P} SELECT id, pattern, round(sum(weight), 6) AS weight FROM cp GROUP BY ALL")
def split_weights(spark, d):
    return _round(st.project(_c2p(spark, d)[1], "pattern"), "weight")


@query("combine_global_stats", f"{_C2P} SELECT id, context, pattern, CAST(2 * matches AS BIGINT) AS matches, CAST(2 * global_pattern_count AS BIGINT) AS global_pattern_count, CAST(2 * global_context_count AS BIGINT) AS global_context_count, round(weight, 6) AS weight FROM cp")
def combine_global_stats(spark, d):
    s = _c2p(spark, d)[1]
    return _stats_out(st.combine(s, s))


@query("combine_splits", f"{_C2P} SELECT id, context, pattern, matches, CAST(CASE WHEN global_pattern_count >= 100 THEN global_pattern_count ELSE 0 END AS BIGINT) AS global_pattern_count, global_context_count, round(weight, 6) AS weight FROM cp")
def combine_splits(spark, d):
    pairs, s = _c2p(spark, d)
    return _stats_out(st.with_global(s, st.global_counts(pairs, s, "pattern").where("count >= 100"), "pattern"))


# ---------------------------------------------------------------- scores


def _score_query(name: str, side: str) -> None:
    base, stats = (_C2P, "cp") if side == "pattern" else (_P2C, "pc")

    @query(f"score_{name}_{side}", f"{base}, {_score_sql(name, stats, 'o', side)} SELECT id, {side}, CASE WHEN round(score, 6) = 0 THEN 0.0::DOUBLE ELSE round(score, 6) END AS score FROM o")
    def run(spark, d):
        pairs, s = (_c2p if side == "pattern" else _p2c)(spark, d)
        kind, args, *_ = _SCORERS[name]
        return _round(sc.score(s, sc.scorer(kind, args), side, st.total_pairs(pairs)))


for _name in _SCORERS:
    for _side in ("pattern", "context"):
        _score_query(_name, _side)


@query("update_weights", f"{_C2P}, {_score_sql('pmi', 'cp', 'o', 'pattern')} SELECT cp.id, context, pattern, matches, global_pattern_count, global_context_count, round(o.score, 6) AS weight FROM cp JOIN o USING (id, pattern)")
def update_weights(spark, d):
    pairs, s = _c2p(spark, d)
    return _stats_out(sc.update_weights(s, sc.score(s, sc.pmi(), "pattern", st.total_pairs(pairs)), "pattern"))


@query("top_results", f"{_C2P}, {_score_sql('pmi', 'cp', 'o', 'pattern')}, r AS (SELECT id, pattern, round(score, 6) AS score FROM o) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, pattern) <= 100")
def top_results(spark, d):
    pairs, s = _c2p(spark, d)
    return sc.top_results(_round(sc.score(s, sc.pmi(), "pattern", st.total_pairs(pairs))), 100, ("pattern",))


@query(
    "combine_scores",
    f"{_C2P}, {_score_sql('pmi', 'cp', 'o', 'pattern')}, {_score_sql('likelihood', 'cp', 'k', 'pattern')} SELECT id, pattern, CASE WHEN abs(sum(score)) < 5e-7 THEN 0.0::DOUBLE ELSE round(sum(score), 6) END AS score FROM (SELECT * FROM o UNION ALL SELECT * FROM k) GROUP BY id, pattern",
)
def combine_scores(spark, d):
    """Scores of two scorers for the same patterns."""
    pairs, s = _c2p(spark, d)
    s = walks.settle(s, "stats")
    return _round(sc.combine_scores(sc.score(s, sc.pmi(), "pattern", st.total_pairs(pairs)).unionByName(sc.score(s, sc.likelihood(), "pattern"))))


_CC = f"{_C2P}, {_project_sql('s2', 'cp', 'pattern')}, {_hop_sql('h2', 's2', 'pattern')}"


@query("compute_context_scores", f"{_CC}, {_score_sql('likelihood', 'cp', 'ps', 'pattern')}, u AS (SELECT h2.id, h2.context, h2.pattern, h2.matches, h2.global_pattern_count, h2.global_context_count, ps.score AS weight FROM h2 JOIN ps USING (id, pattern)), {_score_sql('likelihood', 'u', 'o', 'context')} SELECT id, context, round(score, 6) AS score FROM o")
def compute_context_scores(spark, d):
    pairs = _counted(spark, d)
    first, second = walks.context_to_context(pairs, _seeds(pairs, "context", _SEEDS))
    return _round(walks.context_scores(second, sc.likelihood(), None, first, sc.likelihood()))


_PP = f"{_P2C}, {_project_sql('s2', 'pc', 'context')}, {_hop_sql('h2', 's2', 'context')}"


@query("compute_pattern_scores", f"{_PP}, {_score_sql('likelihood', 'pc', 'cs', 'context')}, u AS (SELECT h2.id, h2.context, h2.pattern, h2.matches, h2.global_pattern_count, h2.global_context_count, cs.score AS weight FROM h2 JOIN cs USING (id, context)), {_score_sql('likelihood', 'u', 'o', 'pattern')} SELECT id, pattern, round(score, 6) AS score FROM o")
def compute_pattern_scores(spark, d):
    pairs = _counted(spark, d)
    first, second = walks.pattern_to_pattern(pairs, _seeds(pairs, "pattern", _SEEDS))
    return _round(walks.pattern_scores(second, sc.likelihood(), None, first, sc.likelihood()))


# ---------------------------------------------------------------- mining


@query(
    "paraphrases",
    f"""WITH {_PAIRS}, c AS (SELECT docid, context, pattern, count(*) AS n FROM pairs GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY docid, context) AS p FROM c),
    x AS (SELECT a.pattern AS id, b.pattern AS pattern, round(sum(a.p * b.p), 6) AS score FROM s a JOIN s b ON a.docid = b.docid AND a.context = b.context GROUP BY ALL)
    SELECT id, pattern, score FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, pattern) <= 5""",
)
def paraphrases(spark, d):
    return mine.paraphrases(_pairs(spark, d), 5, places=6)


_REGEXES = ["[0-9]{3}", "^The ", "(?i)apache license", r"@[a-z0-9]+\.example"]


@query("harvest_sentences", f"WITH s AS (SELECT unnest({_SENT}) AS sentence FROM documents), p AS (SELECT unnest([{', '.join(repr(r) for r in _REGEXES)}]) AS pattern) SELECT pattern, sentence FROM s JOIN p ON regexp_matches(sentence, pattern)".replace("\\\\", "\\"))
def harvest_sentences(spark, d):
    s = _t(spark, d, "documents").select(F.explode(sentences("text")).alias("sentence"))
    return mine.pattern_sentences(s, _REGEXES)


def _espresso_sql(target: str) -> str:
    far = st.other(target)
    return f"""WITH {_PAIRS}, {_seed_sql(target, _SEEDS)}, {_hop_sql('h1', 'seeds', target)}, {_score_sql('likelihood', 'h1', 'a', far)},
      top AS (SELECT id, {far}, score AS weight FROM (SELECT id, {far}, score FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, {far}) <= 100)),
      {_hop_sql('h2', 'top', far)}, {_score_sql('likelihood', 'h2', 'o', target)} SELECT id, {target}, round(score, 6) AS score FROM o"""


@query("espresso_contexts", _espresso_sql("context"))
def espresso_contexts(spark, d):
    pairs = _counted(spark, d)
    return _round(walks.bootstrap(pairs, _seeds(pairs, "context", _SEEDS), sc.likelihood(), 100, "context"))


@query("espresso_patterns", _espresso_sql("pattern"))
def espresso_patterns(spark, d):
    pairs = _counted(spark, d)
    return _round(walks.bootstrap(pairs, _seeds(pairs, "pattern", _SEEDS), sc.likelihood(), 100, "pattern"))


def _espresso_rounds_sql(target: str, keep: int, rounds: int) -> str:
    far, parts, seeds = st.other(target), [f"WITH {_PAIRS}, {_seed_sql(target, _SEEDS)}"], "seeds"
    for r in range(1, rounds + 1):
        parts += [
            _hop_sql(f"f{r}", seeds, target),
            _score_sql("likelihood", f"f{r}", f"a{r}", far),
            f"top{r} AS (SELECT id, {far}, score AS weight FROM a{r} QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, {far}) <= {keep * r})",
            _hop_sql(f"b{r}", f"top{r}", far),
            _score_sql("likelihood", f"b{r}", f"o{r}", target),
            f"n{r} AS (SELECT id, {target}, score AS weight FROM o{r})",
        ]
        seeds = f"n{r}"
    return ", ".join(parts) + f" SELECT id, {target}, round(score, 6) AS score FROM o{rounds}"


@query("espresso_contexts_two_rounds", _espresso_rounds_sql("context", 20, 2))
def espresso_contexts_two_rounds(spark, d):
    pairs = _counted(spark, d)
    return _round(walks.bootstrap(pairs, _seeds(pairs, "context", _SEEDS), sc.likelihood(), 20, "context", rounds=2))


def _such_as(spark, d) -> DataFrame:
    """A sentence for each order of several lines: "the order7 such as part3 , part12 and part40 is here"."""
    l = c_lines(_t(spark, d, "lineitem"))
    n = F.size("names")
    some = F.when(n == 1, F.get("names", 0)).otherwise(F.concat(F.array_join(F.slice("names", 1, n - 1), " , "), F.lit(" and "), F.get("names", n - 1)))
    text = F.concat(F.lit("the order"), F.col("l_orderkey").cast("string"), F.lit(" such as "), some, F.lit(" is here"))
    return annotate(spread(l.select(F.col("l_orderkey").alias("doc_id"), text.alias("text"))))


def c_lines(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("part"), F.col("l_partkey").cast("string")))).alias("names"))


@query(
    "sap_instances",
    """WITH p AS (SELECT DISTINCT l_orderkey, 'part' || l_partkey || '|O' AS instance FROM lineitem)
    SELECT 'order' || l_orderkey || '|O' AS class, instance, CAST(1 AS BIGINT) AS matches FROM p UNION ALL SELECT 'the order' || l_orderkey || '|O', instance, CAST(1 AS BIGINT) FROM p""",
)
def sap_instances(spark, d):
    return instances.instance_counts(instances.such_as_pairs(_such_as(spark, d)))


_LISTS = "lists AS (SELECT 'k' || (s_suppkey % 3) AS class, s_nationkey AS a, (s_nationkey + 1 + s_suppkey % 4) % 25 AS b FROM supplier)"


def _walk_sql() -> str:
    out = [
        f"WITH {_LISTS}, items AS (SELECT class, a, b, count(*) AS freq FROM lists GROUP BY ALL)",
        "e0 AS (SELECT class, a, b, freq, a AS item FROM items UNION ALL SELECT class, a, b, freq, b FROM items)",
        "e AS (SELECT *, sum(freq) OVER (PARTITION BY class, item) AS item_freq FROM e0)",
        "sz AS (SELECT class, count(DISTINCT a * 100 + b)::DOUBLE AS nl, count(DISTINCT item)::DOUBLE AS ni FROM e GROUP BY class)",
        "p0 AS MATERIALIZED (SELECT DISTINCT class, item, 1 / ni AS p FROM e JOIN sz USING (class))",
    ]
    for r in range(instances.ROUNDS):
        out.append(f"q{r} AS MATERIALIZED (SELECT class, a, b, 0.3::DOUBLE / any_value(nl) + 0.7::DOUBLE * sum(p * freq / item_freq) AS q FROM e JOIN p{r} USING (class, item) JOIN sz USING (class) GROUP BY class, a, b)")
        out.append(f"p{r + 1} AS MATERIALIZED (SELECT class, item, 0.3::DOUBLE / any_value(ni) + 0.7::DOUBLE * sum(q / 2) AS p FROM e JOIN q{r} USING (class, a, b) JOIN sz USING (class) GROUP BY class, item)")
    return ", ".join(out) + f" SELECT class, CAST(item AS VARCHAR) AS instance, round(p, 6) AS probability, CAST(ni AS BIGINT) AS total_instances FROM p{instances.ROUNDS} JOIN sz USING (class)"


@query("udap_walk", _walk_sql())
def udap_walk(spark, d):
    s = _t(spark, d, "supplier")
    pair = F.concat_ws("\t", F.col("s_nationkey").cast("string"), ((F.col("s_nationkey") + 1 + F.col("s_suppkey") % 4) % 25).cast("string"))
    return _round(instances.list_walk(s.select(F.concat(F.lit("k"), F.col("s_suppkey") % 3).alias("class"), pair.alias("list"))), "probability")


# ---------------------------------------------------------------- parsed documents


def _turns(spark, d) -> DataFrame:
    return _t(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text")


def _parsed(spark, d) -> DataFrame:
    return annotate(_turns(spark, d))


def _parsed_counts(spark, d, extract, *args) -> DataFrame:
    return ex.pair_counts(extract(_parsed(spark, d), *args, counts=True), whole=not ex.repeats(_turns(spark, d).select("doc_id")))


@query("chunk_pairs")
def chunk_pairs(spark, d):
    return _parsed_counts(spark, d, extract_chunks, True, 0, "l*r")


@query("nary_chunks")
def nary_chunks(spark, d):
    return _parsed_counts(spark, d, extract_nary, 2, 0)


@query("dirt_pairs")
def dirt_pairs(spark, d):
    return _parsed_counts(spark, d, extract_paths)


@query("parse_graph")
def parse_graph_counts(spark, d):
    return parse_graph(_parsed(spark, d))


@query("pos_signatures")
def pos_signatures(spark, d):
    rows = _parsed(spark, d).select("docid", F.posexplode("sentences").alias("sentence", "tokens"))
    return rows.select("docid", "sentence", signature_column(F.col("tokens")).alias("signature"))


@query("relations", "SELECT CAST(c_custkey AS VARCHAR) AS docid, CAST(0 AS INTEGER) AS sentence, 'near' AS rel_name, 'Cust' || c_custkey || ' -> Nation' || c_nationkey AS texts, 0.75::DOUBLE AS confidence FROM customer")
def relation_rows(spark, d):
    docs = _such_as_people(spark, d)
    types = spark.sql("SELECT 'r1' AS rel_id, 'near' AS rel_name, array(named_struct('name', 'who', 'type', 'kb:Name', 'class', 'PERSON'), named_struct('name', 'place', 'type', 'kb:Name', 'class', 'PERSON')) AS args")
    patterns = spark.sql("SELECT * FROM VALUES ('r1', 'PERSON|is in|PERSON|1/2', 0.7D), ('r1', 'PERSON|*|PERSON|1/2', 0.25D), ('r1', 'PERSON|is*|PERSON|1/2', 0.25D), ('r1', 'PERSON|*in|PERSON|1/2', 0.25D) AS t(name, pattern, weight)")
    found = relations.relations(docs, types, patterns, max_skip=2)
    return found.select("docid", "sentence", "rel_name", F.col("args.text").alias("texts"), "confidence").withColumn("texts", F.array_join("texts", " -> "))


def _such_as_people(spark, d) -> DataFrame:
    """A sentence for each customer: "so Cust12 is in Nation7"."""
    n = _t(spark, d, "customer")
    return annotate(spread(n.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("so Cust"), F.col("c_custkey").cast("string"), F.lit(" is in Nation"), F.col("c_nationkey").cast("string")).alias("text"))))


# ---------------------------------------------------------------- collections and formats


@query("vector_dot", "SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * a.embedding[i]::DOUBLE)), 4) AS dot FROM embeddings a")
def vector_dot(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.round(coll.vector_dot("embedding", "embedding"), 4).alias("dot"))


@query(
    "vector_normalize",
    """WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS length FROM embeddings)
    SELECT vec_id, round(length, 4) AS length, CAST(i - 1 AS INTEGER) AS at, CASE WHEN round(embedding[i]::DOUBLE / length, 4) = 0 THEN 0.0::DOUBLE ELSE round(embedding[i]::DOUBLE / length, 4) END AS value FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM n)""",
)
def vector_normalize(spark, d):
    v = F.map_from_arrays(F.sequence(F.lit(0), F.size("embedding") - 1), F.transform("embedding", lambda x: x.cast("double")))
    return _t(spark, d, "embeddings").select("vec_id", F.round(coll.map_length(v), 4).alias("length"), F.explode(coll.map_normalize(v)).alias("at", "value")).withColumn("value", F.round("value", 4))


@query(
    "map_plus",
    """WITH c AS (SELECT event_type, sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) AS even, sum(CASE WHEN user_id % 2 = 1 THEN 2 ELSE 0 END) AS odd FROM events GROUP BY event_type)
    SELECT event_type, CAST(even + odd AS BIGINT) AS total, CAST(even * odd AS DOUBLE) AS dot FROM c""",
)
def map_plus(spark, d):
    per = _t(spark, d, "events").groupBy("event_type").agg(F.sum((F.col("user_id") % 2 == 0).cast("long")).alias("even"), F.sum((F.col("user_id") % 2 == 1).cast("long") * 2).alias("odd"))
    a, b = F.create_map(F.lit("x"), F.col("even")), F.create_map(F.lit("x"), F.col("odd"), F.lit("y"), F.lit(1).cast("long"))
    return per.select("event_type", coll.map_plus(a, b)["x"].alias("total"), coll.map_dot(a, b).alias("dot"))


@query(
    "topn_by_value",
    "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type, CAST(n AS BIGINT) AS n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) <= 2",
)
def topn_by_value(spark, d):
    m = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.inline(coll.entries_by_value("m", 2))).select("user_id", F.col("key").alias("event_type"), F.col("value").alias("n"))


@query(
    "array_functions",
    """SELECT doc_id, CAST(coalesce(list_position(tk, 'the'), 0) - 1 AS BIGINT) AS first_at, array_to_string(tk[2:4], ' ') AS middle, array_to_string(tk[greatest(len(tk) - 2, 1):], ' ') AS last
    FROM (SELECT doc_id, """
    + _TOK
    + " AS tk FROM documents)",
)
def array_functions(spark, d):
    t = _t(spark, d, "documents").select("doc_id", whitespace_tokens("text").alias("tk"))
    return t.select("doc_id", coll.index_of("tk", "the").alias("first_at"), F.array_join(coll.sub_list("tk", 1, 3), " ").alias("middle"), F.array_join(coll.last_n("tk", 3), " ").alias("last"))


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.none'), 'missing') AS other, json_exists(props, '$.k') AS has_k FROM events")
def json_extract(spark, d):
    return _t(spark, d, "events").select("event_id", fmt.json_typed("props", "$.k", "long").alias("k"), fmt.json_get("props", "$.none", "missing").alias("other"), fmt.json_has("props", "k").alias("has_k"))


@query("csv_roundtrip", "SELECT n_nationkey, n_name || ',' || n_regionkey AS row, n_name AS name FROM nation")
def csv_roundtrip(spark, d):
    row = fmt.csv_row("n_name", "n_regionkey")
    return _t(spark, d, "nation").select("n_nationkey", row.alias("row")).withColumn("name", fmt.json_get(fmt.csv_to_json("row", ["name", "region"]), "$.name"))


@query("xml_extract", "SELECT n_nationkey, n_name AS name FROM nation")
def xml_extract(spark, d):
    x = F.concat(F.lit('<n id="1"><name>'), fmt.xml_escape("n_name"), F.lit("</name></n>"))
    return _t(spark, d, "nation").select("n_nationkey", x.alias("x")).select("n_nationkey", fmt.xml_text("x", "n/name").alias("name"))


@query("cookie_headers", "SELECT user_id, event_type AS kind, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def cookie_headers(spark, d):
    header = F.concat(F.lit("user="), F.col("user_id"), F.lit("; kind="), F.url_encode("event_type"))
    e = _t(spark, d, "events").select(fmt.cookies(header).alias("c"))
    return e.select(F.col("c")["user"].cast("long").alias("user_id"), F.col("c")["kind"].alias("kind")).groupBy("user_id", "kind").agg(F.count("*").alias("n"))


_V4 = "list_transform(embedding[1:4], lambda x: CAST(floor(x::DOUBLE * 1000) AS BIGINT))"


def _numbers(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 4), lambda x: F.floor(x.cast("double") * 1000).cast("long")).alias("v"))


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(
    "array_updates",
    f"""WITH t AS (SELECT vec_id, {_V4} AS v FROM embeddings)
    SELECT vec_id, array_to_string(list_append(v, 7), ',') AS added, array_to_string(v[1:1] || [8] || v[2:], ',') AS inserted, array_to_string(v[1:1] || [9] || v[3:], ',') AS changed,
      array_to_string(v[2:], ',') AS removed, v[3] AS third, array_to_string(list_sort(v), ',') AS rising, array_to_string(list_reverse_sort(v), ',') AS falling FROM t""",
)
def array_updates(spark, d):
    n = lambda x: F.lit(x).cast("long")
    out = {
        "added": coll.array_add("v", n(7)),
        "inserted": coll.array_insert("v", 1, n(8)),
        "changed": coll.array_set("v", 1, n(9)),
        "removed": coll.array_remove_at("v", 0),
        "rising": coll.array_sorted("v"),
        "falling": coll.array_sorted("v", True),
    }
    return _numbers(spark, d).select("vec_id", *[_joined(c).alias(k) for k, c in out.items()], coll.array_get("v", 2).alias("third"))


@query(
    "array_sets",
    f"""WITH t AS (SELECT vec_id, label, {_V4} AS v, list_transform(range(0, 5), lambda i: i + label) AS r FROM embeddings)
    SELECT vec_id, array_to_string(list_sort(list_distinct(list_filter(r, lambda x: x IN (1, 3, 5, 7)))), ',') AS common, array_to_string(CASE WHEN list_contains(r, 3) THEN r ELSE list_append(r, 3) END, ',') AS with_three,
      CAST(CASE WHEN list_contains(v, v[1]) THEN 4 - list_position(list_reverse(v), v[1]) ELSE -1 END AS INTEGER) AS last_at, array_to_string(range(label, label + 3), ',') AS numbers, ((vec_id - 100) % 7 + 7) % 7 AS rest, lower(printf('%08x', vec_id)) AS bytes FROM t""",
)
def array_sets(spark, d):
    t = _numbers(spark, d).withColumn("r", F.transform(coll.int_range(F.lit(0), F.lit(5)), lambda i: (i + F.col("label")).cast("long")))
    odd = F.array(*[F.lit(x).cast("long") for x in (7, 5, 3, 1)])
    return t.select(
        "vec_id",
        _joined(coll.sorted_intersection("r", odd)).alias("common"),
        _joined(coll.add_unique("r", F.lit(3).cast("long"))).alias("with_three"),
        coll.last_index_of("v", F.get("v", 0)).cast("int").alias("last_at"),
        _joined(coll.int_range(F.col("label").cast("int"), (F.col("label") + 3).cast("int"))).alias("numbers"),
        coll.mod(F.col("vec_id") - 100, F.lit(7)).cast("long").alias("rest"),
        F.lower(F.hex(coll.int_bytes("vec_id"))).alias("bytes"),
    )


@query(
    "map_updates",
    """SELECT event_id, event_type = 'click' AS has_value, user_id + 1 AS raised, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE event_type END AS put, CAST(1 AS BIGINT) AS n_left, event_type IN ('click', 'view') AS has_key, event_id * 2 AS total FROM events""",
)
def map_updates(spark, d):
    m = F.create_map(F.lit("kind"), F.col("event_type"))
    more = F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("kind"), F.lit("even"))).otherwise(F.create_map(F.lit("other"), F.lit("odd")))
    return _t(spark, d, "events").select(
        "event_id",
        coll.map_contains_value(m, F.lit("click")).alias("has_value"),
        coll.map_increment(F.create_map(F.lit("n"), F.col("user_id")), F.lit("n"), F.lit(1).cast("long"))["n"].alias("raised"),
        coll.map_put_all(m, more)["kind"].alias("put"),
        F.size(coll.map_remove(coll.map_put(m, F.lit("gone"), F.lit("x")), "gone")).cast("long").alias("n_left"),
        coll.map_contains_key(F.create_map(F.lit("click"), F.lit(1), F.lit("view"), F.lit(2)), F.col("event_type")).alias("has_key"),
        coll.map_plus(F.create_map(F.lit("a"), F.col("event_id")), F.create_map(F.lit("a"), F.col("event_id")))["a"].alias("total"),
    )


@query("entries_by_key", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type, CAST(n AS BIGINT) AS n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type) <= 2")
def entries_by_key(spark, d):
    m = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.inline(coll.entries_by_key("m", 2))).select("user_id", F.col("key").alias("event_type"), F.col("value").alias("n"))


@query("tuple_order", "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY CASE WHEN n_regionkey = 1 THEN 0 ELSE 1 END, CASE WHEN n_regionkey = 1 THEN '*' END, n_name, n_nationkey) AS BIGINT) AS place FROM nation")
def tuple_order(spark, d):
    n = _t(spark, d, "nation").withColumn("symbol", F.when(F.col("n_regionkey") == 1, "*"))
    key = coll.tuple_order(("n_name", "symbol"), ("n_nationkey", F.lit(None).cast("string")))
    return n.select("n_nationkey", F.row_number().over(Window.orderBy(key)).cast("long").alias("place"))


@query(
    "vector_pairs",
    """WITH e AS (SELECT vec_id, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
    SELECT vec_id, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i]::DOUBLE * b[i]::DOUBLE)), 4) AS dot FROM e WHERE b IS NOT NULL""",
)
def vector_pairs(spark, d):
    after = F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    return _t(spark, d, "embeddings").withColumn("b", after).where("b is not null").select("vec_id", F.round(coll.vector_dot("embedding", "b"), 4).alias("dot"))


@query(
    "json_updates",
    """SELECT event_id, '{"k":' || k || ',"n":"x"}' AS put, '{}' AS removed, '{"k":' || (k + 5) || '}' AS raised, '{"k":[' || k || ',"y"]}' AS accumulated, '{"k":' || k || ',"list":[1]}' AS appended, true AS none
    FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
)
def json_updates(spark, d):
    e = _t(spark, d, "events").select("event_id", fmt.json_object(k=fmt.json_typed("props", "$.k", "long")).alias("j"))
    text = F.lit('"y"')
    return e.select(
        "event_id",
        fmt.json_put("j", "n", F.lit('"x"')).alias("put"),
        fmt.json_remove("j", "k").alias("removed"),
        fmt.json_increment("j", "k", 5).alias("raised"),
        fmt.json_accumulate("j", "k", text).alias("accumulated"),
        fmt.json_append("j", "list", F.lit("1")).alias("appended"),
        fmt.json_is_null("j", "none").alias("none"),
    )


@query(
    "json_arrays",
    """SELECT event_id, user_id || '-"' || event_type || '"' AS joined, '[' || user_id || ',true]' AS put, '["' || event_type || '"]' AS removed, '[' || user_id || ',"' || event_type || '",null,0]' AS padded FROM events""",
)
def json_arrays(spark, d):
    j = F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(","), fmt.json_quote("event_type"), F.lit("]"))
    return _t(spark, d, "events").select("event_id", fmt.json_array_join(j, "-").alias("joined"), fmt.json_array_put(j, 1, F.lit("true")).alias("put"), fmt.json_array_remove(j, 0).alias("removed"), fmt.json_array_put(j, 3, F.lit("0")).alias("padded"))


@query(
    "json_values",
    """SELECT event_id, '"' || event_type || '"' AS word, CAST(event_id AS VARCHAR) AS number, 'true' AS flag, CAST(event_id % 255 AS VARCHAR) AS hexadecimal, CAST(2 AS BIGINT) AS n_names, 'a,b' AS names FROM events""",
)
def json_values(spark, d):
    e = _t(spark, d, "events")
    j = fmt.json_object(b="event_type", a="user_id")
    return e.select(
        "event_id",
        fmt.coerce("event_type").alias("word"),
        fmt.coerce(F.col("event_id").cast("string")).alias("number"),
        fmt.coerce(F.lit("TRUE")).alias("flag"),
        fmt.coerce(F.concat(F.lit("0x"), F.lower(F.hex(F.col("event_id") % 255)))).alias("hexadecimal"),
        fmt.json_length(j).cast("long").alias("n_names"),
        F.array_join(fmt.json_names(j), ",").alias("names"),
    )


@query(
    "csv_tables",
    r'''SELECT o_orderkey, '[{"id":"' || o_orderkey || '","name":"a, \"b\""},{"id":"2","name":"' || o_orderstatus || '"}]' AS rows, 'id,name' || chr(10) || o_orderkey || ',"a, ""b""' || chr(34) || chr(10) || '2,' || o_orderstatus AS text FROM orders''',
)
def csv_tables(spark, d):
    text = F.concat(F.lit("id,name\n"), F.col("o_orderkey").cast("string"), F.lit(',"a, ""b"""\n2,'), F.col("o_orderstatus"))
    o = _t(spark, d, "orders").select("o_orderkey", fmt.csv_table_to_json(text).alias("rows"))
    return o.withColumn("text", fmt.json_to_csv("rows", ["id", "name"]))


@query("jsonml_elements", """SELECT c_custkey, '["customer",{"segment":"' || c_mktsegment || '"},["name",{},"' || c_name || '"],"end"]' AS element FROM customer""")
def jsonml_elements(spark, d):
    inner = fmt.jsonml(F.lit("name"), F.create_map().cast("map<string,string>"), fmt.json_quote("c_name"))
    whole = fmt.jsonml(F.lit("customer"), F.create_map(F.lit("segment"), F.col("c_mktsegment")), inner, fmt.json_quote(F.lit("end")))
    return _t(spark, d, "customer").select("c_custkey", whole.alias("element"))


@query("http_messages", "SELECT event_id, 'GET' AS method, '/u/' || user_id AS target, '404' AS status, 'Not Found' AS reason, event_type AS cookie, 'true' AS secure, '/' || user_id AS path, event_type AS kind FROM events")
def http_messages(spark, d):
    user = F.col("user_id").cast("string")
    ask = fmt.http_start(F.concat(F.lit("GET /u/"), user, F.lit(" HTTP/1.1\r\nHost: x\r\n\r\n")))
    answer = F.concat(F.lit("HTTP/1.1 404 Not Found\nX-Kind: a\nx-kind: "), F.col("event_type"), F.lit("\n\nbody: no"))
    c = fmt.cookie(F.concat(F.lit("kind="), F.url_encode("event_type"), F.lit("; Path=/"), user, F.lit("; Secure")))
    return _t(spark, d, "events").select("event_id", ask["method"].alias("method"), ask["target"].alias("target"), fmt.http_start(answer)["status"].alias("status"), fmt.http_start(answer)["reason"].alias("reason"), c["value"].alias("cookie"), c["secure"].alias("secure"), c["path"].alias("path"), fmt.http_headers(answer)["x-kind"].alias("kind"))


from . import files  # noqa: E402, F401  (registers its queries with the decorator above)
