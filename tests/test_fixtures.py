"""Small cases with results worked out by hand."""

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from patternloom.functions import formats, nlp
from patternloom.functions.tokenize import sentences, tag_tokens
from patternloom.operators import extract as ex
from patternloom.operators import score as sc
from patternloom.operators import stats as st
from patternloom.plans import instances, mine, relations, walks
from patternloom.sources import readers, writers


def tok(token, pos, chunk, ne="O", dep="", head=0):
    return {"token": token, "begin": 0, "end": 0, "lemma": token.lower(), "pos": pos, "chunk": chunk, "ne": ne, "dep_type": dep, "dep_index": head, "coref_id": -1}


LIVES = [
    tok("Dorothy", "NNP", "B-NP", "PERSON", "nsubj", 2),
    tok("lives", "VBZ", "B-VP", "O", "root", 0),
    tok("in", "IN", "B-PP", "O", "prep", 2),
    tok("Kansas", "NNP", "B-NP", "LOCATION", "pobj", 3),
]


def tokens(spark, text, docid="d"):
    return spark.createDataFrame([(docid, text.split())], "docid string, tokens array<string>")


def pairs(df):
    return sorted((r.context, r.pattern) for r in df.collect())


@pytest.mark.parametrize(
    "text, want",
    [
        ("The U.S.A. didn't <b>win</b>, ok? a&amp;b", "the usa didnt win , ok ? a & b"),
        ("end. Next", "end . next"),
        ("3.14", "14"),
        ("example.com", "example com"),
        ("<script>x y</script>z", "z"),
        ("U.S.A., ok", "usa ok"),
        (None, ""),
    ],
)
def test_tag_tokens(spark, text, want):
    assert " ".join(spark.createDataFrame([(text,)], "t string").select(tag_tokens("t")).first()[0]) == want


def test_sentences(spark):
    assert spark.createDataFrame([("One two.\nThree? Four",)], "t string").select(sentences("t")).first()[0] == ["One two.", "Three?", "Four"]


@pytest.mark.parametrize(
    "style, want",
    [
        ("l*r", [("a|c", "b")]),
        ("l", [("a|*", "b"), ("b|*", "c")]),
        ("r", [("*|b", "a"), ("*|c", "b")]),
        ("l+r", [("*|b", "a"), ("*|c", "b"), ("a|*", "b"), ("b|*", "c")]),
    ],
)
def test_ngram_styles(spark, style, want):
    assert pairs(ex.ngram_pairs(tokens(spark, "a b c"), style=style)) == sorted(want)


def plain_ngrams(ws, lo, hi, most, skip, style):
    out = []
    for i in range(len(ws)):
        for p in range(1, most + 1):
            if i + p > len(ws):
                continue
            lefts = [" ".join(ws[i - s - n : i - s]) for s in range(skip + 1) if s == 0 or i - (s - 1) - hi >= 0 for n in range(lo, hi + 1) if i - s - n >= 0]
            rights = [" ".join(ws[i + p + s : i + p + s + n]) for s in range(skip + 1) for n in range(lo, hi + 1) if i + p + s + n <= len(ws)]
            pat = " ".join(ws[i : i + p])
            if style == "l*r":
                out += [(f"{a}|{b}", pat) for a in lefts for b in rights]
            if style in ("l", "l+r"):
                out += [(f"{a}|*", pat) for a in lefts]
            if style in ("r", "l+r"):
                out += [(f"*|{b}", pat) for b in rights]
    return sorted(out)


@pytest.mark.parametrize("style", ex.STYLES)
@pytest.mark.parametrize("text", ["a b c d e f g", "a", "a b"])
def test_ngram_sizes_and_skips(spark, style, text):
    got = pairs(ex.ngram_pairs(tokens(spark, text), 1, 2, 2, 1, style))
    assert got == plain_ngrams(text.split(), 1, 2, 2, 1, style)


def test_posts(spark):
    post = {"id": 1, "text": "Hello World", "created_at": "Thu Sep 01 12:34:56 +0000 2011", "retweeted": False, "user": {"screen_name": "u", "location": "LA"}}
    lines = spark.createDataFrame([(json.dumps(post),), (json.dumps({**post, "retweeted": True}),), ("{broken",)], "value string")
    posts = ex.parse_posts(lines)
    assert posts.count() == 2
    assert pairs(ex.post_cooccurrence(posts, 2)) == [("1", "hello"), ("1", "hello world"), ("1", "world")]
    assert pairs(ex.geo_temporal_pairs(posts, 1, "day")) == [("2011:9:1", "hello"), ("2011:9:1", "world")]
    assert pairs(ex.geo_temporal_pairs(posts, 1, "day", geo=True)) == [("2011:9:1|la", "hello"), ("2011:9:1|la", "world")]
    assert {c for c, _ in pairs(ex.geo_temporal_pairs(posts, 1, "month", 1, 1))} == {"2011:8", "2011:9", "2011:10"}
    assert ex.geo_temporal_pairs(posts, 1, geo=False, temporal=False).count() == 0


def test_scores(spark):
    p = ex.ngram_pairs(tokens(spark, "a b c a b d"))
    assert p.count() == 4
    seeds = spark.createDataFrame([("1", "a|c", 1.0), ("1", "a|d", 1.0)], "id string, context string, weight double")
    s = walks.context_to_pattern(p, seeds)
    assert sorted((r.context, r.pattern, r.matches, r.global_context_count, r.global_pattern_count) for r in s.collect()) == [("a|c", "b", 1, 1, 2), ("a|d", "b", 1, 1, 2)]
    total = st.total_pairs(p)
    value = lambda by: sc.score(s, by, "pattern", total).first().score
    assert value(sc.pmi()) == pytest.approx(math.log(2))
    assert value(sc.pmi(expected=True)) == pytest.approx(math.log(2) / 4)
    assert value(sc.likelihood()) == pytest.approx(1)
    assert value(sc.fmeasure(0.5)) == pytest.approx(1)
    assert value(sc.tfidf("log", "idf")) == pytest.approx(math.log(2) ** 2)
    with pytest.raises(ValueError):
        sc.score(s, sc.pmi(), "pattern")
    for bad in (("pmi", None), ("likelihood", "1"), ("tfidf", "x:idf"), ("none", None)):
        with pytest.raises(ValueError):
            sc.scorer(*bad)


def test_seeds_and_unmatched(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("1\t*\tdorothy\t1\n2\tx|y\ttin man\t2\n")
    s = readers.seeds(spark, str(tmp_path / "s.tsv"))
    assert sorted((r.id, r.context, r.pattern) for r in s.collect()) == [("1", None, "dorothy"), ("2", "x|y", "tin man")]
    assert [r.id for r in st.read_seeds(s, "context").collect()] == ["2"]
    out = st.extract(ex.ngram_pairs(tokens(spark, "a b c")), st.read_seeds(s, "context"), "context", keep_unmatched=True).collect()
    assert [(r.context, r.matches) for r in out] == [("x|y", 0)]


def test_paraphrases(spark):
    got = {(r.id, r.pattern): r.score for r in mine.paraphrases(ex.ngram_pairs(tokens(spark, "a x b a y b")), 10).collect()}
    assert {k: got[k] for k in (("x", "x"), ("x", "y"), ("y", "x"), ("y", "y"))} == dict.fromkeys((("x", "x"), ("x", "y"), ("y", "x"), ("y", "y")), 0.25)
    assert got["a", "a"] == got["b", "b"] == 1


def test_passages(spark):
    docs = spark.createDataFrame([("d", [f"s{k}" for k in range(5)])], "docid string, sentences array<string>")
    got = {r.passage: r.sentences for r in ex.passages(docs, 1, 1).collect()}
    assert got == {0: ["s0", "s1"], 1: ["s0", "s1", "s2"], 2: ["s1", "s2", "s3"], 3: ["s2", "s3", "s4"]}


def test_chunks():
    assert nlp.signature(LIVES) == "NOPN"
    assert nlp.chunk_ids(LIVES) == [1, 2, 2, 3]
    such = [tok(w, p, "B-NP") for w, p in zip("animals such as cats and dogs".split(), "NNS JJ IN NNS CC NNS".split(), strict=True)]
    assert nlp.signature(such) == "NAPNCN"
    assert nlp.chunk_ids(such, True) == [1, 2, 2, 3, 3, 3]
    x, y = instances.such_as(such)
    assert [nlp.chunks_of(c) for c in (x, y)] == [["animals|O"], ["cats|O", "dogs|O"]]
    assert nlp.chunks_of(y, False, True, False, False) == ["cats\tdogs"]


def test_nary_pairs():
    got = Counter((c, p) for c, p, _ in nlp.nary_pairs(LIVES, 2, 0))
    want = Counter()
    for a, pattern, b in (("Dorothy", "PERSON||_||VP|", "lives"), ("Dorothy", "PERSON|*|PP|", "in"), ("Dorothy", "PERSON|lives|PP|", "in"), ("lives", "VP||_||PP|", "in"), ("lives", "VP|*|LOCATION|", "Kansas"), ("lives", "VP|in|LOCATION|", "Kansas"), ("in", "PP||_||LOCATION|", "Kansas")):
        want[f"{a}|{b}", pattern + "1/2"] += 1
        want[f"{b}|{a}", pattern + "0/2"] += 1
    # neighbours with one chunk between: the gap star and the chunk itself
    assert set(got) >= {k for k in want if "_" in k[1]}
    assert all(("|".join(reversed(c.split("|"))), p[:-3] + "0/2") in got for c, p in got if p.endswith("1/2"))


def test_dependency_paths():
    assert sorted(nlp.path_pairs(LIVES)) == sorted(
        [("Dorothy|Kansas", "PERSON|nsubj|VB|lives|VB|prep|IN|in|pobj|LOCATION"), ("Kansas|Dorothy", "LOCATION|pobj|in|IN|prep|VB|lives|VB|nsubj|PERSON")]
    )


def parsed(spark, *sentences_):
    from patternloom.schema import PARSED

    return spark.createDataFrame([("d", [list(s) for s in sentences_])], PARSED)


def test_parse_graph(spark):
    got = {tuple(r) for r in nlp.parse_graph(parsed(spark, LIVES)).collect()}
    assert got == {("dorothy", "lives", "NNP", "VBZ", "nsubj", 1), ("lives", "[**ROOT**]", "VBZ", "[**ROOT**]", "root", 1), ("in", "lives", "IN", "VBZ", "prep", 1), ("kansas", "lives", "NNP", "VBZ", "pobj_IN", 1)}


def test_walk_fixed_point(spark):
    lists = spark.createDataFrame([("animals", "cats\tdogs")], "class string, list string")
    got = {r.instance: (r.probability, r.total_instances) for r in instances.list_walk(lists, rounds=5).collect()}
    assert got == {"cats": (pytest.approx(0.5), 2), "dogs": (pytest.approx(0.5), 2)}


def test_relations(spark, tmp_path):
    # "lives in" as one chunk
    sent = [LIVES[0], LIVES[1], {**LIVES[2], "chunk": "I-VP"}, LIVES[3]]
    (tmp_path / "t").write_text("r1\tlivesIn\tperson\tkb:Person\tPERSON\tplace\tkb:Place\tLOCATION\n")
    (tmp_path / "p").write_text("r1\tPERSON|lives in|LOCATION|1/2\t0.7\n")
    types, patterns = readers.relation_types(spark, str(tmp_path / "t")), readers.relation_patterns(spark, str(tmp_path / "p"))
    found = relations.relations(parsed(spark, sent), types, patterns)
    r = found.collect()
    assert [(x.rel_name, x.confidence, [(a.name, a.text, a.start) for a in x.args]) for x in r] == [("livesIn", 0.7, [("person", "Dorothy", 0), ("place", "Kansas", 3)])]
    people = relations.individuals(parsed(spark, sent), {"PERSON": "kb:Person"})
    assert [(p.text, p.type) for p in people.collect()] == [("Dorothy", "kb:Person")]
    xml = relations.to_xml(found, people).first().xml
    assert '<individual type="kb:Person">Dorothy</individual>' in xml and '<relation name="livesIn"' in xml
    more = spark.createDataFrame([("TOWN", "Kansas")], "name string, pattern string")
    assert "TOWN" in str(relations.classes(relations.argument_rows(parsed(spark, sent)), more).select("classes").collect())


def test_readers(spark, tmp_path):
    (tmp_path / "trec").write_text("<DOC><DOCNO> D1 </DOCNO>hello</DOC>\n<DOC id='D2'>x</DOC>\n")
    assert sorted((r.docid, r.content) for r in readers.trec(spark, str(tmp_path / "trec")).collect()) == [("D1", "<DOC><DOCNO> D1 </DOCNO>hello</DOC>"), ("D2", "<DOC id='D2'>x</DOC>")]
    (tmp_path / "lines").write_text("a\ttext one\nno tab here\n")
    got = sorted(r.content for r in readers.lines(spark, str(tmp_path / "lines")).collect())
    assert got == ["no tab here", "text one"]
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "f.txt").write_text("l1\nl2")
    assert [tuple(r) for r in readers.whole_files(spark, str(tmp_path / "whole")).collect()] == [("f.txt", "l1\nl2")]
    body = "HTTP/1.1 200 OK\r\nContent-Length: 5\r\nhello"
    record = f"WARC/0.18\r\nWARC-Type: response\r\nWARC-TREC-ID: t-1\r\nContent-Length: {len(body)}\r\n\r\n{body}"
    import gzip

    (tmp_path / "w.warc.gz").write_bytes(gzip.compress(record.encode()) + gzip.compress(record.replace("t-1", "t-2").encode()))
    rows = readers.warc(spark, str(tmp_path / "w.warc.gz")).collect()
    assert [(r.docid, r.record_type, r.text) for r in rows] == [("t-1", "response", "hello"), ("t-2", "response", "hello")]


def test_writers(spark, tmp_path):
    docs = parsed(spark, LIVES)
    writers.parsed(docs, str(tmp_path / "p"))
    assert readers.parsed(spark, str(tmp_path / "p")).count() == 1
    writers.parsed(docs, str(tmp_path / "t"), text=True)
    line = spark.read.text(str(tmp_path / "t")).first()[0]
    assert line.startswith('<doc id="d">\t<sentence>\t1\tDorothy') and line.endswith("</sentence>\t</doc>")
    writers.tsv(spark.createDataFrame([("a", 1)], "x string, y int"), str(tmp_path / "tsv"))
    assert spark.read.text(str(tmp_path / "tsv")).first()[0] == "a\t1"


def test_tsv_keeps_values(spark, tmp_path):
    values = [" lead", "trail ", "nul\x00in", "\x01ctl\x1f", "#no comment", '"q" it\'s', "back\\", ""]
    writers.tsv(spark.createDataFrame([(v, None, 0.5) for v in values], "x string, y string, z double"), str(tmp_path / "t"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "t")).collect()) == sorted(f"{v}\t\t0.5" for v in values)


def test_formats(spark):
    df = spark.createDataFrame([('{"a":{"b":"x"},"n":5}', "true", "0x1F", "it's", "A: 1\r\nB: 2\r\na: 3\r\n\r\nbody", "k=v%20w; z=1")], "j string, t string, h string, s string, http string, c string")
    r = df.select(
        formats.json_get("j", "$.a.b").alias("b"), formats.json_typed("j", "$.n", "int").alias("n"), formats.json_names("j").alias("names"), formats.coerce("t").alias("t"), formats.coerce("h").alias("h"), formats.coerce("s").alias("s"),
        formats.http_headers("http").alias("http"), formats.cookies("c").alias("c"), formats.element_to_jsonml(F.lit("p"), F.create_map(F.lit("k"), F.lit("v")), F.lit("x")).alias("ml"),
    ).first()
    assert (r.b, r.n, r.names, r.t, r.h, r.s) == ("x", 5, ["a", "n"], "true", "31", '"it\'s"')
    assert r.http == {"a": "3", "b": "2"} and r.c == {"k": "v w", "z": "1"} and r.ml == '["p",{"k":"v"},"x"]'


def test_lines_have_own_ids(spark, tmp_path):
    """Equal lines are different documents, named by file and byte offset, also where a file is split."""
    from patternloom.sources import readers

    (tmp_path / "a").mkdir()
    text = "".join(f"same line\nélan {k}\n" for k in range(3000)) + "last"
    (tmp_path / "a" / "x.txt").write_text(text, encoding="utf-8")
    (tmp_path / "a" / "more").mkdir()
    (tmp_path / "a" / "more" / "y.txt").write_text("id\ttext\r\nsame line\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = {r.docid: r.content for r in readers.lines(spark, str(tmp_path / "a")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    raw, at, want = text.encode(), 0, {"id": "text", "y.txt:9": "same line"}
    for line in raw.split(b"\n"):
        want[f"x.txt:{at}"] = line.decode()
        at += len(line) + 1
    assert rows == want


def test_unclosed_record(spark, tmp_path):
    from patternloom.sources import readers

    (tmp_path / "a.xml").write_text("<DOC><DOCNO> D1 </DOCNO>hello</DOC>\n<DOC>unclosed")
    (tmp_path / "b.xml").write_text("x<DOC id='D2'>y</DOC>")
    rows = {r.docid: r.content for r in readers.trec(spark, str(tmp_path)).collect()}
    assert rows == {"D1": "<DOC><DOCNO> D1 </DOCNO>hello</DOC>", "D2": "<DOC id='D2'>y</DOC>"}


def test_archive_streams(tmp_path):
    """Records are read from gzip members, bzip2 and plain bytes alike, one at a time."""
    import bz2
    import gzip

    from patternloom.sources.readers import _Stream, parse_warc

    def record(k, body):
        return f"WARC/0.18\r\nWARC-Type: response\r\nWARC-TREC-ID: d{k}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    bodies = [b"Content-Length: 1\nWARC/ inside", b"y" * 3_000_000, b""]
    records = [record(k, b) for k, b in enumerate(bodies)]
    for raw in (b"".join(records), b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records)), bz2.compress(b"".join(records))):
        got = list(parse_warc(raw))
        assert [r["docid"] for r in got] == ["d0", "d1", "d2"] and [r["content"] for r in got] == bodies
    assert _Stream(b"abc").take(2) == b"ab"


def test_passage_ids_with_bars(spark):
    from patternloom.operators import extract as ex

    docs = spark.createDataFrame([("a|b", ["x y", "z", "w"])], "docid string, sentences array<string>")
    rows = ex.passage_pairs(docs, lambda w: ex.cooccurrence_pairs(w, 1)).collect()
    assert {r.docid for r in rows} == {"a|b"} and {r.context for r in rows} == {"a|b|0", "a|b|1"}


def test_counters_and_annotators(spark):
    from pyspark.sql import Observation

    from patternloom.functions import nlp

    docs = spark.createDataFrame([("1", "One is here. Two is there."), ("2", None)], "doc_id string, text string")
    seen = Observation()
    own = nlp.load_annotator("patternloom.functions.nlp:rule_annotator")
    nlp.counted(nlp.annotate(docs, own), seen).collect()
    assert (seen.get["documents"], seen.get["failures"], seen.get["sentences"], seen.get["tokens"]) == (2, 1, 2, 8)
    with pytest.raises(ModuleNotFoundError):
        nlp.load_annotator("no_such_module:x")


def test_unmatched_seeds(spark):
    from patternloom.operators import stats as st

    pairs = spark.createDataFrame([("1", "a", "x"), ("1", "a", "x"), ("1", "a", "y"), ("1", "b", "z")], "docid string, context string, pattern string")
    seeds = spark.createDataFrame([("1", "a", 1.0), ("1", "none", 2.0), ("2", "b", 3.0)], "id string, context string, weight double")
    got = {(r.id, r.context, r.pattern): (r.matches, r.global_context_count, r.weight) for r in st.extract(pairs, seeds, "context", 2, True).collect()}
    assert got == {("1", "a", "x"): (2, 3, 1.0), ("1", "none", None): (0, 0, 2.0), ("2", "b", None): (0, 1, 3.0)}
    assert {tuple(r) for r in st.extract(pairs, seeds, "context", 2).collect()} == {tuple(r) for r in st.extract(st.counted(pairs), seeds, "context", 2).collect()}


def test_many_patterns(spark, monkeypatch):
    """More patterns than a pass takes."""
    from patternloom.plans import mine

    monkeypatch.setattr(mine, "PATTERNS", 3)
    rows = spark.createDataFrame([(f"w{k} x",) for k in range(10)], "sentence string")
    got = {tuple(r) for r in mine.pattern_sentences(rows, [f"w{k} " for k in range(10)]).collect()}
    assert got == {(f"w{k} ", f"w{k} x") for k in range(10)}
    assert mine.pattern_sentences(rows, []).count() == 0


def test_treebank_tokens(spark):
    from pyspark.sql import functions as F

    from patternloom.functions.tokenize import ptb_tokens

    row = spark.range(1).select(ptb_tokens(F.lit('He said, "They\'ll go (now)... won\'t they?" It\'s Mr. Hill\'s.')).alias("t")).first()
    assert row.t == ["He", "said", ",", "``", "They", "'ll", "go", "(", "now", ")", "...", "wo", "n't", "they", "?", "''", "It", "'s", "Mr.", "Hill", "'s", "."]


def test_documents_in_slices(spark, monkeypatch):
    """Objects are made of a few documents at once; counts of repeated ids are summed."""
    docs = parsed(spark, LIVES).select("docid", F.explode(F.sequence(F.lit(1), F.lit(400))).alias("k"), "sentences")
    docs = docs.select(F.concat("docid", (F.col("k") % 390).cast("string")).alias("docid"), F.when(F.col("k") % 7 > 0, F.col("sentences")).alias("sentences"))
    held = []
    monkeypatch.setattr(nlp, "SLICE", 40)
    for batch in docs.toArrow().combine_chunks().to_batches():
        rows = list(nlp.documents(batch, nlp.CHUNKED))
        assert len(rows) == 400 and set(rows[1][1][0][0]) == set(nlp.CHUNKED)
        for (_, got), want in zip(rows, batch.column(1).to_pylist(), strict=True):
            assert [[t["token"] for t in s] for s in got] == [[t["token"] for t in s] for s in want or ()]
        held += rows
    assert len(held) == 400
    plain = ex.pair_counts(nlp.extract_chunks(docs)).collect()
    counts = ex.pair_counts(nlp.extract_chunks(docs, counts=True)).collect()
    assert ex.repeats(docs.select("docid")) and not ex.repeats(docs.select("docid").distinct())
    assert sorted(plain) == sorted(counts) and max(r.matches for r in counts) == 2


def test_short_texts_are_spread(spark):
    docs = spark.range(100).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("so Cust1 is in Nation7").alias("text"))
    assert nlp.annotate(nlp.spread(docs)).select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def test_counts_within_documents(spark):
    """Counts and best values made within a row are those of pairs that are shuffled."""
    texts = ["a x b a y b a x b", "", "a", "q q q q", "a x b a z b", "a y b"]
    docs = spark.createDataFrame([(str(k), t.split()) for k, t in enumerate(texts)], "docid string, tokens array<string>")
    made = ex.counts_within(docs, ex.ngram_array(), True)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(made.collect()) == sorted(ex.pair_counts(ex.ngram_pairs(docs)).collect())
    twice = docs.unionByName(docs)
    assert sorted(ex.counts_within(twice, ex.ngram_array(), False).collect()) == sorted(ex.pair_counts(ex.ngram_pairs(twice)).collect())
    best = ex.top_within(docs, F.col("tokens"), 2).where("docid = '0'").collect()
    assert [(r.pattern, r.matches) for r in best] == [("a", 3), ("b", 3)]


def test_walks_count_once_and_broadcast_few(spark, tmp_path, monkeypatch):
    names = []
    settle = walks.settle
    monkeypatch.setattr(walks, "settle", lambda df, name: names.append(name) or settle(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([("d", "a x b a y b".split())], "docid string, tokens array<string>")
        seeds = spark.createDataFrame([("1", "a|b", 1.0)], "id string, context string, weight double")
        assert walks.hop(ex.ngram_pairs(docs), seeds).count() == 2 and names == ["pairs", "matches"]
        counts = spark.createDataFrame([("a|b", "x", 2)], "context string, pattern string, matches long")
        assert "SortMergeJoin" not in st.extract(counts, seeds)._jdf.queryExecution().executedPlan().toString()
        (tmp_path / "f").write_text("1\tone\n2\ttwo\n")
        assert "SortMergeJoin" not in readers.lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
