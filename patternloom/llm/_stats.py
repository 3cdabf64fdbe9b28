"""Quality statistics of texts, in one vectorised pass; shared by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import map_batches

#: whole-number statistics, in the order of their columns
COUNTS = ("n_bytes", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_letters", "n_digits", "n_bang", "n_pipe", "n_edge_symbols", "max_word")


def _is(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOLS = _is(b"#*$%&|<>")
_UPPER = _is(bytes(range(65, 91)))
_DIGIT = _is(b"0123456789")
_BANG = _is(b"!?")
_PIPE = _is(b"|")
_LEAD = ~_is(bytes(range(128, 192)))  # first bytes of code points
_LETTER = _is(bytes(c for c in range(128) if chr(c).isalpha())) | _is(bytes(range(192, 256)))
_EDGE = _is(b"#*$%&|<>!?=@^~")


def stats(arr) -> dict[str, np.ndarray]:
    """COUNTS of each text; a null text counts as empty."""
    data, offs = W.column(arr)
    n = len(offs) - 1
    out = {c: np.zeros(n, np.int64) for c in COUNTS}
    out["n_bytes"][:] = np.diff(offs)
    for lo, hi in W.slices(offs):
        at = slice(lo, hi)
        rows = hi - lo
        w = W.scan(data, offs, lo, hi)
        per = np.bincount(w.row, minlength=rows)
        out["n_words"][at] = per
        out["word_chars"][at] = W.count(data, offs, lo, hi, _LEAD & W.NOT_SPACE)
        for name, table in (("n_symbols", _SYMBOLS), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_digits", _DIGIT), ("n_bang", _BANG), ("n_pipe", _PIPE)):
            out[name][at] = W.count(data, offs, lo, hi, table)
        if len(w.row):
            out["n_edge_symbols"][at] = np.bincount(w.row[_EDGE[data[w.end - 1]]], minlength=rows)
            np.maximum.at(longest := np.zeros(rows, np.int64), w.row, w.end - w.start)
            out["max_word"][at] = longest
            order = np.lexsort((w.hash, w.row))
            r, h = w.row[order], w.hash[order]
            first = np.ones(len(r), bool)
            first[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
            out["n_distinct"][at] = np.bincount(r[first], minlength=rows)
        # words in windows of five that are found twice or more
        i, h = W.windows(w, 5)
        if len(i):
            order = np.lexsort((h, w.row[i]))
            r, h = w.row[i][order], h[order]
            i = i[order]
            same = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
            some = np.flatnonzero(same)
            for k in range(5):  # equal hashes count only for equal words
                a, b = i[some] + k, i[some + 1] + k
                same[some] &= W.same(data, w.start[a], w.end[a], w.start[b], w.end[b])
            twice = np.zeros(len(r), bool)
            twice[1:] |= same
            twice[:-1] |= same
            hit = np.zeros(len(w.row) + 1, np.int64)
            np.add.at(hit, i[twice], 1)
            np.add.at(hit, i[twice] + 5, -1)
            out["n_repeat_words"][at] = np.bincount(w.row[np.cumsum(hit[:-1]) > 0], minlength=rows)
        # lines with a word, and those equal to an earlier one
        ln = W.scan(data, offs, lo, hi, W.NOT_NEWLINE)
        if len(ln.row):
            with_word = np.searchsorted(w.start, ln.end) > np.searchsorted(w.start, ln.start)
            r, h, a, z = ln.row[with_word], ln.hash[with_word], ln.start[with_word], ln.end[with_word]
            order = np.lexsort((h, r))
            r, h, a, z = r[order], h[order], a[order], z[order]
            again = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
            some = np.flatnonzero(again)
            again[some] &= W.same(data, a[some], z[some], a[some + 1], z[some + 1])
            out["n_lines"][at] = np.bincount(r, minlength=rows)
            out["n_dup_lines"][at] = np.bincount(r[1:][again], minlength=rows)
    return out


def with_stats(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with a long column for each of COUNTS (named with ``prefix``)."""
    columns = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{prefix}{c}` long" for c in COUNTS)])

    def add(batches):
        import pyarrow as pa

        for batch in batches:
            s = stats(batch.column(columns.index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(s[c]) for c in COUNTS)], names=[*columns, *(prefix + c for c in COUNTS)])

    return map_batches(docs, add, schema)


#: ratios that the learners see, as SQL over COUNTS (``{p}`` is the prefix)
RATIOS = {
    "log_words": "ln(1 + {p}n_words)",
    "word_length": "{p}word_chars / greatest({p}n_words, 1)",
    "symbol_share": "{p}n_symbols / greatest({p}word_chars, 1)",
    "edge_symbol_share": "{p}n_edge_symbols / greatest({p}n_words, 1)",
    "bang_share": "{p}n_bang / greatest({p}n_words, 1)",
    "pipe_share": "{p}n_pipe / greatest({p}n_words, 1)",
    "upper_share": "{p}n_upper / greatest({p}n_letters, 1)",
    "digit_share": "{p}n_digits / greatest({p}word_chars, 1)",
    "dup_line_share": "{p}n_dup_lines / greatest({p}n_lines, 1)",
    "repeat_share": "{p}n_repeat_words / greatest({p}n_words, 1)",
    "distinct_share": "{p}n_distinct / greatest({p}n_words, 1)",
    "line_words": "ln(1 + {p}n_words / greatest({p}n_lines, 1))",
    "longest_word": "ln(1 + {p}max_word)",
}


def ratios(prefix: str = "") -> list[Column]:
    return [F.expr(f"cast({e.format(p=prefix)} as double)").alias(n) for n, e in RATIOS.items()]


def ratio(name: str, prefix: str = "") -> Column:
    return F.expr(f"cast({RATIOS[name].format(p=prefix)} as double)")
