"""Linguistic building blocks over parsed sentences, and a small rule-based annotator.

A sentence is a list of token dicts with the fields of ``schema.TOKEN``.
Trained taggers are not part of this package: ``Annotator`` is what one has to
offer, and already annotated documents are an input format of their own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import permutations, product
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ANY, PARSED, PIPE
from ..session import ship

Token = dict
MAX_SENTENCE = 100

# fixed values: term patterns over tag signatures, tag classes
BASIC = re.compile("D?((A|N)+|((A|N)*(NP)?)(A|N)*)N")
COMPOSITE = re.compile("(X|D)?((A|N)+|((A|N)*(NP)?)(A|N)*)NX*(C+(X|D)?((A|N)+|((A|N)*(NP)?)(A|N)*)NX*)*")
ENTITIES = ("LOCATION", "PERSON", "ORGANIZATION")
BRACKETS = ("-LRB-", "-RRB-", "-LCB-", "-RCB-", "-LSB-", "-RSB-")
ROOT = "[**ROOT**]"


# ---------------------------------------------------------------- signatures and chunks


def tag_class(token: str, pos: str, ne: str) -> str:
    if ne in ENTITIES or pos in ("VBG", "POS", "CD") or pos[:2] in ("NN", "PR", "WP"):
        return "N"
    if pos[:2] == "JJ":
        return "A"
    if pos[:2] in ("IN", "TO"):
        return "P"
    if token in (",", "and"):
        return "C"
    if not "A" <= pos[:1] <= "Z":
        return "X"
    return "D" if pos == "DT" else "O"


def signature(tokens: list[Token]) -> str:
    return "".join(tag_class(t["token"], t["pos"], t["ne"]) for t in tokens)


def signature_column(tokens: Column) -> Column:
    """The signature of an array of tokens, as an expression."""

    def of(t):
        pos, two = t["pos"], F.substring(t["pos"], 1, 2)
        return (
            F.when(t["ne"].isin(*ENTITIES) | pos.isin("VBG", "POS", "CD") | two.isin("NN", "PR", "WP"), "N")
            .when(two == "JJ", "A")
            .when(two.isin("IN", "TO"), "P")
            .when(t["token"].isin(",", "and"), "C")
            .when(~pos.rlike("^[A-Z]"), "X")
            .when(pos == "DT", "D")
            .otherwise("O")
        )

    return F.array_join(F.transform(tokens, of), "")


def chunk_ids(tokens: list[Token], composite: bool = False) -> list[int]:
    """A growing number for each term that the pattern finds in the signature, and for each stretch between."""
    sig = signature(tokens)
    cuts, last = [], 0
    for m in (COMPOSITE if composite else BASIC).finditer(sig):
        cuts += [(last, m.start())] * (m.start() > last) + [m.span()]
        last = m.end()
    cuts += [(last, len(sig))] * (last < len(sig))
    return [k for k, (a, z) in enumerate(cuts, 1) for _ in range(z - a)]


def is_punctuation(token: str) -> bool:
    return token in BRACKETS or not re.search("[0-9A-Za-z]", token)


def main_chunk(tokens: list[Token], tag: bool) -> str | None:
    """Words without punctuation, joined; with ``|`` and the last entity tag if asked for."""
    words = [t for t in tokens if not is_punctuation(t["token"])]
    if not words:
        return None
    ne = next((t["ne"] for t in reversed(words) if t["ne"] != "O"), "O")
    return " ".join(t["token"] for t in words) + (PIPE + ne if tag else "")


def general_chunk(tokens: list[Token], tag: bool) -> str | None:
    """The trailing run of nouns."""
    k = len(tokens)
    while k and tokens[k - 1]["pos"].startswith("NN"):
        k -= 1
    return main_chunk(tokens[k:], tag) if k < len(tokens) else None


def chunks_of(tokens: list[Token], split: bool = True, specific: bool = True, general: bool = True, tag: bool = True) -> list[str]:
    """Distinct terms of one chunk: itself if it is a basic term, else its basic parts, or (unless split) the parts
    joined by tabs."""
    if not specific and not general:
        raise ValueError("specific or general")
    sig = signature(tokens)
    whole = bool(tokens) and BASIC.fullmatch(sig)
    parts = [tokens] if whole else [tokens[m.start() : m.end()] for m in BASIC.finditer(sig)]
    mains = [c for p in parts if specific and (c := main_chunk(p, tag))]
    generals = [c for p in parts if (general or whole and specific) and (c := general_chunk(p, tag))]
    if not split and not whole:
        mains, generals = (["\t".join(x)] if x else [] for x in (mains, generals))
    return list(dict.fromkeys(mains + generals))


# ---------------------------------------------------------------- chunk extractors


def typed_chunks(tokens: list[Token]) -> list[tuple[str, str, int]]:
    """(text, type, first token) of runs with one entity tag, or of chunks that begin with B or O outside entities."""
    groups: list[list[int]] = []
    last = None
    for i, t in enumerate(tokens):
        if t["ne"] != last or t["ne"] == "O" and t["chunk"][:1] in ("B", "O"):
            groups.append([])
        groups[-1].append(i)
        last = t["ne"]
    out = []
    for g in groups:
        ne = next((tokens[i]["ne"] for i in reversed(g) if tokens[i]["ne"] != "O"), None)
        first = tokens[g[0]]["chunk"]
        out.append((" ".join(tokens[i]["token"] for i in g), ne or (first[2:] if len(first) > 2 else first), g[0]))
    return out


def chunk_pairs(tokens: list[Token], surface: bool = True, max_skip: int = 0, style: str = "l*r") -> Iterator[tuple[str, str]]:
    """(context, pattern) of neighbouring chunks, and of chunks with chunks around; each also reversed (``|-``)."""
    last, groups = None, []
    for t in tokens:
        if t["ne"] != last or t["ne"] == "O" and t["chunk"][:1] in ("B", "O"):
            groups.append((t["chunk"], []))
        groups[-1][1].append(t["token"])
        last = t["ne"]
    names = [" ".join(ws) + ("" if surface else PIPE + (tag[2:] if len(tag) > 2 else "")) for tag, ws in groups]

    def both(left: str, pattern: str, right: str):
        yield left + PIPE + right, pattern
        yield right + PIPE + left, "|-" + pattern

    for a, b in zip(names, names[1:], strict=False):
        yield from both(a, a + "|_|", b)
        yield from both(a, "|_|" + b, b)
    skips = range(max_skip + 1)
    for p, name in enumerate(names):
        lefts = [names[p - s - 1] for s in skips if p - s - 1 >= 0]
        rights = [names[p + s + 1] for s in skips if p + s + 1 < len(names)]
        if style == "l*r":
            for a, b in product(lefts, rights):
                yield from both(a, name, b)
        for a in lefts if style in ("l", "l+r") else ():
            yield from both(a, name, ANY)
        for b in rights if style in ("r", "l+r") else ():
            yield from both(ANY, name, b)


def nary_pairs(tokens: list[Token], arity: int = 2, max_skip: int = 0) -> Iterator[tuple[str, str, tuple[int, ...]]]:
    """(context, pattern, first token of each argument) for all growing choices of ``arity`` chunks.

    Between neighbours i < j lie at most max_skip + 1 chunks, and a pattern
    chunk p in i..j-1 stands for them: its text with ``*`` for chunks left out
    on either side, or ``|_|`` where nothing lies between.  Every order of the
    arguments gives a row, marked by how many orders are left.
    """
    chunks = typed_chunks(tokens)

    def segments(i: int, j: int) -> list[str]:
        out = []
        for p in range(i, j):
            text, before, after = chunks[p][0], p - i > 1, j - p > 1
            if not before and not after:
                out.append("|_|" if p == i else text)
            elif p == i:
                out.append("*")
            else:
                out.append(("*" if p > i + 1 else "") + text + ("*" if p + 1 < j else ""))
        return out

    def choices(first: int, left: int) -> Iterator[list[int]]:
        if not left:
            yield [first]
            return
        for j in range(first + 1, min(len(chunks), first + max_skip + 3)):
            for rest in choices(j, left - 1):
                yield [first, *rest]

    orders = list(permutations(range(arity)))
    for start in range(len(chunks)):
        for pick in choices(start, arity - 1):
            for segs in product(*(segments(i, j) for i, j in zip(pick, pick[1:], strict=False))):
                pattern = "".join(chunks[i][1] + PIPE + s + PIPE for i, s in zip(pick, segs, strict=False)) + chunks[pick[-1]][1] + PIPE
                for k, order in enumerate(orders):
                    yield PIPE.join(chunks[pick[x]][0] for x in order), f"{pattern}{len(orders) - 1 - k}/{arity}", tuple(chunks[pick[x]][2] for x in order)


def path_pairs(tokens: list[Token], style: str = "l*r", head_only: bool = False, lemmas: bool = False) -> Iterator[tuple[str, str]]:
    """(context, pattern) for pairs of dependency paths that meet in a word from different children."""
    ids = chunk_ids(tokens)
    names: list[str] = []
    for k in range(len(tokens)):
        names.append(" ".join(t["token"] for t, i in zip(tokens, ids, strict=True) if i == ids[k]))
    children: dict[int, list[int]] = {}
    for k, t in enumerate(tokens, 1):
        if t["dep_type"] != "punct":
            children.setdefault(t["dep_index"], []).append(k)
    at = lambda k: tokens[k - 1]
    word = lambda k: at(k)["lemma" if lemmas else "token"]
    kind = lambda k: at(k)["ne"] if at(k)["ne"] != "O" else (at(k)["chunk"][2:] if len(at(k)["chunk"]) > 2 else at(k)["chunk"])

    def half(path: list[int]) -> list[list[str]]:
        """From the leaf up to below the meeting word: [word, pos, dep], the leaf only its dep."""
        nodes = path[:1] if head_only else path[:-1]
        return [([] if i == 0 else [word(k), at(k)["pos"][:2]]) + [at(k)["dep_type"]] for i, k in enumerate(nodes)]

    def join(left: list[int], right: list[int]) -> Iterator[tuple[str, str]]:
        if any(ids[p[0] - 1] == ids[k - 1] for p in (left, right) for k in p[1:]):
            return
        root = left[-1]
        mid = [at(root)["pos"][:2], word(root), at(root)["pos"][:2]]
        up = [x for step in half(left) for x in step]
        down = [x for step in reversed(half(right)) for x in reversed(step)]
        pattern = PIPE.join([kind(left[0]), *up, *mid, *down, kind(right[0])])
        a, b = names[left[0] - 1], names[right[0] - 1]
        if style == "l*r":
            yield a + PIPE + b, pattern
        if style in ("l", "l+r"):
            yield a + PIPE + ANY, pattern
        if style in ("r", "l+r"):
            yield ANY + PIPE + b, pattern

    def visit(k: int) -> tuple[list[list[int]], list[tuple[str, str]]]:
        seen, out = [], []
        for c in children.get(k, ()):
            below, found = visit(c)
            out += found
            paths = [[*p, k] for p in below]
            for a, b in product(seen, paths):
                out += [*join(a, b), *join(b, a)]
            seen += paths
        return [*seen, [k]], out

    for top in children.get(0, ()):
        yield from visit(top)[1]


SLICE, ROWS = 1 << 13, 1 << 15  # tokens that a Python worker holds as objects at once, about, and rows that it gives at once


def documents(batch, fields: tuple[str, ...] = ()) -> Iterator[tuple[str, list[list[Token]]]]:
    """(docid, sentences) of a batch, their tokens with some fields only (all if none are named); a few documents
    become Python objects at once, so memory doesn't follow the batch."""
    import numpy as np

    ids, docs = batch.column(0), batch.column(1)
    ends = docs.values.offsets.to_numpy()
    at = docs.offsets.to_numpy()
    upto, tokens = ends[at], docs.values.values
    names = [f.name for f in tokens.type if not fields or f.name in fields]
    lo = 0
    while lo < len(docs):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + SLICE, side="right")) - 1)
        hi = min(hi, len(docs), lo + SLICE)
        base = int(upto[lo])
        some = tokens.slice(base, int(upto[hi]) - base)
        rows = [dict(zip(names, t, strict=True)) for t in zip(*[some.field(n).to_pylist() for n in names], strict=True)]
        cut = (ends[at[lo] : at[hi] + 1] - base).tolist()
        edge = (at[lo : hi + 1] - at[lo]).tolist()
        for docid, a, z in zip(ids.slice(lo, hi - lo).to_pylist(), edge, edge[1:], strict=False):
            yield docid, [rows[cut[k] : cut[k + 1]] for k in range(a, z)]
        lo = hi


BATCH_BYTES = 8 << 20


def over_documents(docs: DataFrame, make, schema: str, kinds, fields: tuple[str, ...] = ()) -> DataFrame:
    """make(docid, sentences) gives the rows of each parsed document (docid, sentences); kinds(): their Arrow types."""
    ship(docs.sparkSession)
    # batches by size: documents are of any length
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches):
        import pyarrow as pa

        kind = pa.schema(kinds())

        def batch_of(rows):
            columns = zip(*rows, strict=True) if rows else [()] * len(kind)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

        rows: list[tuple] = []
        for batch in batches:
            for docid, sentences in documents(batch, fields):
                for row in make(docid, sentences):
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield batch_of(rows)
                        rows = []
        yield batch_of(rows)

    return docs.select("docid", "sentences").mapInArrow(run, schema)


def _over_sentences(docs: DataFrame, make, fields: tuple[str, ...] = (), counts: bool = False) -> DataFrame:
    """Pairs of make(tokens) for each sentence of parsed docs (docid, sentences); with counts, each pair of a row of docs
    once with its number of matches."""

    def rows(docid, sentences):
        pairs = (p for s in sentences for p in make(s))
        return ((docid, c, p, n) for (c, p), n in Counter(pairs).items()) if counts else ((docid, c, p) for c, p in pairs)

    def kinds():
        import pyarrow as pa

        return [(n, pa.string()) for n in ("docid", "context", "pattern")] + [("matches", pa.int64())] * counts

    return over_documents(docs, rows, "docid string, context string, pattern string" + ", matches long" * counts, kinds, fields)


CHUNKED = ("token", "chunk", "ne")


def extract_chunks(docs: DataFrame, surface: bool = True, max_skip: int = 0, style: str = "l*r", counts: bool = False) -> DataFrame:
    return _over_sentences(docs, lambda s: chunk_pairs(s, surface, max_skip, style), CHUNKED, counts)


def extract_nary(docs: DataFrame, arity: int = 2, max_skip: int = 0, counts: bool = False) -> DataFrame:
    return _over_sentences(docs, lambda s: ((c, p) for c, p, _ in nary_pairs(s, arity, max_skip)), CHUNKED, counts)


def extract_paths(docs: DataFrame, style: str = "l*r", head_only: bool = False, lemmas: bool = False, counts: bool = False) -> DataFrame:
    return _over_sentences(docs, lambda s: path_pairs(s, style, head_only, lemmas), ("lemma", "pos", "dep_type", "dep_index", *CHUNKED), counts)


# ---------------------------------------------------------------- parse graph


def parse_graph(docs: DataFrame) -> DataFrame:
    """Counts of (term, head, pos, head_pos, dep_type); heads tagged CC, IN or TO give way to their own head."""

    def edge(t, s):
        head = F.get(s, t["dep_index"] - 1)
        over = head["pos"].isin("CC", "IN", "TO")
        up = F.get(s, head["dep_index"] - 1)
        top = (t["dep_index"] == 0) | (over & (head["dep_index"] == 0))
        return F.struct(
            F.lower(t["token"]).alias("term"),
            F.when(top, ROOT).when(over, F.lower(up["token"])).otherwise(F.lower(head["token"])).alias("head"),
            t["pos"].alias("pos"),
            F.when(top, ROOT).when(over, up["pos"]).otherwise(head["pos"]).alias("head_pos"),
            F.when((t["dep_index"] != 0) & over, F.concat_ws("_", t["dep_type"], head["pos"])).otherwise(t["dep_type"]).alias("dep_type"),
        )

    edges = F.flatten(F.transform("sentences", lambda s: F.transform(s, lambda t: edge(t, s))))
    return docs.select(F.inline(edges)).groupBy("term", "head", "pos", "head_pos", "dep_type").agg(F.count("*").alias("count"))


def tagged_tokens(tokens: Column, pos: Column, ne: Column) -> Column:
    """Tokens with tags as an array of structs; lengths must agree."""
    same = (F.size(tokens) == F.size(pos)) & (F.size(tokens) == F.size(ne))
    zipped = F.transform(F.arrays_zip(tokens.alias("token"), pos.alias("pos"), ne.alias("ne")), lambda z: F.struct(z["token"].alias("token"), z["pos"].alias("pos"), z["ne"].alias("ne")))
    return F.when(same, zipped).otherwise(F.raise_error(F.lit("tokens and tags differ in number")))


# ---------------------------------------------------------------- annotation


class Annotator(Protocol):
    def __call__(self, text: str) -> list[list[Token]]: ...


_DETERMINERS = {"the", "a", "an", "this", "that", "these", "those", "la", "le", "les", "der", "die", "das", "el", "los", "las"}
_PREPOSITIONS = {"in", "of", "on", "at", "by", "for", "from", "with", "as", "de", "en", "von", "mit"}
_CONJUNCTIONS = {"and", "or", "but", "et", "und", "y"}
_VERBS = {"is", "are", "was", "were", "be", "has", "have", "lives", "est", "ist", "es"}


def rule_tag(word: str) -> str:
    low = word.lower()
    if not re.search(r"\w", word):
        return word[:1] if word[:1] in ",.:" else "SYM"
    if low in _DETERMINERS:
        return "DT"
    if low in _PREPOSITIONS:
        return "IN"
    if low == "to":
        return "TO"
    if low in _CONJUNCTIONS:
        return "CC"
    if low in _VERBS:
        return "VBZ"
    if word[0].isdigit():
        return "CD"
    if low == "such" or low.endswith(("able", "ous", "ful", "ble")):
        return "JJ"
    if low.endswith("ed"):
        return "VBD"
    if low.endswith("ing"):
        return "VBG"
    return "NNS" if low.endswith("s") and len(low) > 3 else "NN"


def rule_annotator(text: str) -> list[list[Token]]:
    """A baseline without trained models: suffix tags, entity tags by capitals inside a sentence, heads by position.
    Sentences of more than 100 tokens are left out."""
    out = []
    for m in re.finditer(r"[^.!?\n]+[.!?]?", text or ""):
        words = [(w[0], m.start() + w.start(), m.start() + w.end()) for w in re.finditer(r"\w+(?:['-]\w+)*|[^\w\s]", m[0])]
        if not words or len(words) > MAX_SENTENCE:
            continue
        tags = [rule_tag(w) for w, *_ in words]
        nes = ["PERSON" if i and w[:1].isupper() and tags[i].startswith("NN") else "O" for i, (w, *_) in enumerate(words)]
        tags = ["NNP" if n != "O" else t for t, n in zip(tags, nes, strict=True)]
        phrase = ["NP" if t[:2] in ("NN", "DT", "JJ", "CD", "PR") else "VP" if t[:2] == "VB" else "PP" if t in ("IN", "TO") else "O" for t in tags]
        chunk = [p if p == "O" else ("I-" if i and phrase[i - 1] == p and not (p == "NP" and tags[i] == "DT") else "B-") + p for i, p in enumerate(phrase)]
        root = next((i for i, t in enumerate(tags) if t[:2] == "VB"), 0)
        sentence = []
        for i, (w, a, z) in enumerate(words):
            p = phrase[i]
            if i == root:
                dep, head = "root", 0
            elif p == "O":
                dep, head = ("punct" if is_punctuation(w) else "dep"), root + 1
            elif p == "NP" and i + 1 < len(words) and phrase[i + 1] == "NP" and chunk[i + 1][:1] == "I":
                dep, head = ("det" if tags[i] == "DT" else "amod"), i + 2
            elif p == "NP":
                k = next((k for k in range(i, -1, -1) if phrase[k] == "PP" or k == root), None)
                over = k is not None and phrase[k] == "PP"
                dep, head = ("pobj", k + 1) if over else ("nsubj" if i < root else "dobj", root + 1)
            else:
                dep, head = ("prep" if p == "PP" else "conj"), root + 1
            sentence.append({"token": w, "begin": a, "end": z, "lemma": w.lower(), "pos": tags[i], "chunk": chunk[i], "ne": nes[i], "dep_type": dep, "dep_index": head, "coref_id": -1})
        out.append(sentence)
    return out


def load_annotator(path: str) -> Annotator:
    """An annotator by import path (``package.module:name``), such as a wrapper of trained models; it is imported where
    Python workers run."""
    import importlib

    module, _, name = path.partition(":")
    importlib.import_module(module)  # an unknown module fails here rather than in a worker
    held: dict[str, Annotator] = {}

    def annotator(text: str) -> list[list[Token]]:
        if name not in held:
            held[name] = getattr(importlib.import_module(module), name)
        return held[name](text)

    return annotator


def counted(parsed: DataFrame, counters) -> DataFrame:
    """parsed with counters (an ``Observation``) of documents, of those without sentences, of sentences and of tokens."""
    tokens = F.aggregate(F.transform("sentences", F.size), F.lit(0), lambda n, x: n + x)
    return parsed.observe(
        counters,
        F.count(F.lit(1)).alias("documents"),
        F.count(F.when(F.coalesce(F.size("sentences"), F.lit(0)) <= 0, 1)).alias("failures"),
        F.sum(F.greatest(F.size("sentences"), F.lit(0))).alias("sentences"),
        F.sum(tokens).alias("tokens"),
    )


def spread(docs: DataFrame) -> DataFrame:
    """docs dealt to all cores: few bytes of short texts lie in few partitions, but annotating them is much work."""
    spark = docs.sparkSession
    return docs.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def annotate(docs: DataFrame, annotator: Annotator = rule_annotator, text: str = "text", docid: str = "doc_id") -> DataFrame:
    """Parsed documents (docid, sentences).  Sentences that an annotator fails on should be left out by it."""
    ship(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches):
        import pyarrow as pa

        fields = [("token", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("lemma", pa.string()), ("pos", pa.string()), ("chunk", pa.string()), ("ne", pa.string()), ("dep_type", pa.string()), ("dep_index", pa.int32()), ("coref_id", pa.int32())]
        kind = pa.list_(pa.list_(pa.struct(fields)))
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                made, n = [], 0  # as many texts as have about SLICE tokens
                while lo + len(made) < batch.num_rows and n < SLICE and len(made) < SLICE:
                    made.append(annotator(batch.column(1)[lo + len(made)].as_py()))
                    n += sum(map(len, made[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(made)), pa.array(made, kind)], names=["docid", "sentences"])
                lo += len(made)

    return docs.select(F.col(docid).cast("string").alias("docid"), F.col(text)).mapInArrow(run, PARSED)


def render_sentence(tokens: Column | str) -> Column:
    """A sentence as one tab-separated line with numbered tokens, on which sentence patterns are matched."""
    one = lambda t, i: F.concat_ws("\t", (i + 1).cast("string"), t["token"], t["begin"].cast("string"), t["end"].cast("string"), t["lemma"], t["pos"], t["chunk"], t["ne"], t["dep_type"], t["dep_index"].cast("string"))
    return F.concat_ws("\t", F.lit("<sentence>"), F.array_join(F.transform(tokens, one), "\t"), F.lit("</sentence>"))
