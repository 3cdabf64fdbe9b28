"""Secret scans by a trigram inverted index (operator 8).

Each rule's regular expression is turned into a Boolean query over trigrams
that any match must contain (literal runs joined by AND, branches by OR,
case-folded).  Every block of documents gets an inverted index of the
trigrams that the rules ask for (trigram to sorted row numbers, one vectorised
pass over the block's bytes); the queries intersect and unite postings, and
only candidates are verified by the regular expression.  A rule whose query
has no mandatory trigram (``hex``) scans fully.

The index of a block lives as long as the block, so nothing is shuffled and
memory follows the block.  A null text is empty and has no span.  Spans that
start together are in the order of kinds; rows that repeat are scanned each; an
empty table gives an empty result.  A column of docs named ``secrets`` is kept
as ``document_secrets``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser as sre  # the parse tree of regular expressions

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import give_way, map_batches


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern, the group whose length counts, and its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = True


#: the base kinds, in the order in which they are listed
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the runs of [0-9a-f]+ that have 24 or more
)
#: kinds that the method adds
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", base=False),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", base=False),
    Rule("url_login", r"[a-z]{1,12}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@", base=False),
)


# ---------------------------------------------------------------- queries


def _fold(s: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in s)


#: a query: True (no condition), ("tri", t), ("and", [...]) or ("or", [...])
def _and(parts: list):
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _or(parts: list):
    return True if any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def _of(text: str):
    raw = text.encode()
    return _and([("tri", raw[k : k + 3]) for k in range(len(raw) - 2)])


def query(pattern: str):
    """The trigram query of a regular expression; True where nothing is mandatory.

    A walk over the parse tree keeps the set of exact strings that a piece can
    match while there are few; where it ends, their trigrams become conditions.
    """
    most = 32

    def cross(a: set[str], b: set[str]) -> set[str] | None:
        out = {x + y for x in a for y in b}
        return out if len(out) <= most else None

    def conditions(strings: set[str]):
        return _or([_of(s) for s in sorted(strings)])

    def walk(items) -> tuple[set[str] | None, object]:
        """The exact strings of a sequence (None if many), and its query."""
        exact: set[str] | None = {""}
        whole, found = True, []
        for item in items:
            one, q = piece(*item)
            found.append(q)
            if one is None:
                whole = False
                if exact is not None:
                    found.append(conditions(exact))
                exact = {""}
                continue
            joined = cross(exact, one)
            if joined is None:
                whole = False
                found.append(conditions(exact))
                joined = one
            exact = joined
        found.append(conditions(exact))
        return (exact if whole else None), _and(found)

    def piece(op, av) -> tuple[set[str] | None, object]:
        name = str(op)
        if name == "LITERAL":
            return {_fold(chr(av))}, True
        if name == "IN":
            chars: set[str] = set()
            for kind, v in av:
                if str(kind) == "LITERAL":
                    chars.add(_fold(chr(v)))
                elif str(kind) == "RANGE" and v[1] - v[0] < 4:
                    chars |= {_fold(chr(c)) for c in range(v[0], v[1] + 1)}
                else:
                    return None, True
            return (chars if len(chars) <= 8 else None), True
        if name == "SUBPATTERN":
            return walk(av[3])
        if name == "BRANCH":
            parts = [walk(p) for p in av[1]]
            strings = None if any(p[0] is None for p in parts) else set().union(*(p[0] for p in parts))
            return (strings if strings is not None and len(strings) <= most else None), _or([p[1] for p in parts])
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, sub = av
            one, q = walk(sub)
            if (low, high) == (0, 1) and one is not None:
                return one | {""}, True
            if low == high and one is not None and low <= 8:
                out: set[str] | None = {""}
                for _ in range(low):
                    out = cross(out, one) if out is not None else None
                return out, True
            return None, (q if low else True)
        return None, True

    return walk(list(sre.parse(pattern)))[1]


def trigrams(q) -> set[bytes]:
    return set() if q is True else {q[1]} if q[0] == "tri" else set().union(*(trigrams(x) for x in q[1]))


# ---------------------------------------------------------------- index


class Block:
    """Inverted index of a slice of texts over the trigrams of some queries."""

    def __init__(self, wanted: list[bytes]):
        self.codes = np.sort(np.array([b[0] << 16 | b[1] << 8 | b[2] for b in wanted], np.int64))
        self.first = np.zeros(256, bool)
        self.first[[int(c) >> 16 for c in self.codes]] = True

    def index(self, data: np.ndarray, offs: np.ndarray, lo: int, hi: int) -> dict[int, np.ndarray]:
        """Trigram code to sorted rows (from lo); a trigram across two rows counts for neither."""
        out = {int(c): np.zeros(0, np.int64) for c in self.codes}
        for base in range(int(offs[lo]), int(offs[hi]), W.BLOCK):
            stop = min(base + W.BLOCK + 2, int(offs[hi]))
            seg = W.LOWER[data[base:stop]]
            at = np.flatnonzero(self.first[seg[:-2]]) if len(seg) > 2 else np.zeros(0, np.int64)
            code = (seg[at].astype(np.int64) << 16) | (seg[at + 1].astype(np.int64) << 8) | seg[at + 2]
            k = np.searchsorted(self.codes, code)
            ok = (k < len(self.codes)) & (self.codes[np.minimum(k, len(self.codes) - 1)] == code)
            at, code = at[ok] + base, code[ok]
            row = np.searchsorted(offs[lo : hi + 1], at, side="right") - 1
            inside = at + 2 < offs[lo + 1 + row] if len(row) else np.zeros(0, bool)
            for c in np.unique(code[inside]):
                out[int(c)] = np.union1d(out[int(c)], row[inside & (code == c)])
        return out

    def rows(self, q, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
        if q is True:
            return np.arange(n)
        if q[0] == "tri":
            b = q[1]
            return postings[b[0] << 16 | b[1] << 8 | b[2]]
        parts = [self.rows(x, postings, n) for x in q[1]]
        if q[0] == "or":
            return np.unique(np.concatenate(parts))
        out = parts[0]
        for p in sorted(parts[1:], key=len):
            out = np.intersect1d(out, p, assume_unique=True)
        return out


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def find(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text") -> DataFrame:
    """docs with ``secrets``: spans (code points, end exclusive) by start, then kind as listed."""
    docs = give_way(docs, ("secrets",))
    columns = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", secrets {SPANS}"

    def run(batches):
        import pyarrow as pa

        queries = [query(r.pattern) for r in rules]
        compiled = [re.compile(r.pattern) for r in rules]
        block = Block(sorted(set().union(*(trigrams(q) for q in queries))))
        full = [k for k, q in enumerate(queries) if q is True]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            arr = batch.column(columns.index(text))
            data, offs = W.column(arr)
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            for lo, hi in W.slices(offs):
                postings = block.index(data, offs, lo, hi)
                todo: dict[int, list[int]] = {}
                for k, q in enumerate(queries):
                    if q is not True:
                        for r in block.rows(q, postings, hi - lo):
                            todo.setdefault(lo + int(r), []).append(k)
                for r in range(lo, hi) if full else todo:
                    ks = full + todo.get(r, [])
                    s = arr[r].as_py()
                    if not s:
                        continue
                    found = []
                    for k in ks:
                        rule = rules[k]
                        for m in compiled[k].finditer(s):
                            if len(m[rule.group]) >= rule.least:
                                found.append((m.start(), k, m.end()))
                    spans[r] = [{"kind": rules[k].kind, "start": a, "end": b, "base": rules[k].base} for a, k, b in sorted(found)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*columns, "secrets"])

    return map_batches(docs, run, schema)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base kinds, the digest of base spans, and all spans."""
    found = find(docs.select("doc_id", "text")).drop("text")

    def written(a):
        return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["base"])
    counts = [count(r.kind) for r in BASE]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))
