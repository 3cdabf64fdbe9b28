"""Benchmark decontamination by one Aho-Corasick automaton (operator 7).

Test items are normalised (A-Z lowered, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``)
and cut into windows of ``size`` words; a shorter item is one window.  One
automaton over all windows, as sequences of word numbers, scans each text
once; hits are mapped back to the words' own offsets.

The automaton goes to every task, so its input is bounded: items go in blocks of
``block_chars`` characters, one automaton and one pass each, built once for
each Python worker.  Up to one block the hits are final; beyond it the texts are held under row
numbers, each block leaves its hits as narrow rows, and a last step unites them
for each document; no item is left out.

Nulls and texts without words are clean; items without words, or null, have no
window.  An item without an item_id marks words but isn't counted or named.
Equal items all count.  Rows that repeat a doc_id are scanned each; an empty
table gives an empty result, an empty benchmark no hits.  Columns of docs named
like results are kept with the prefix ``document_``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import give_way, map_batches, spill

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    """A-Z lowered, nothing else: bytes of other characters stay as they are."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text)) if text else []


class Scanner:
    """The automaton over (item_id, text) pairs."""

    def __init__(self, items: list[tuple], size: int = 10):
        try:
            import ahocorasick
        except ImportError as e:
            raise ImportError("decontamination needs the package pyahocorasick where Python workers run") from e

        self.number: dict[str, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ws = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            for k in range(max(1, len(ws) - size + 1) if ws else 0):
                owners.setdefault(tuple(ws[k : k + size]), set()).update([str(item)] if item is not None else [])
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, ids in owners.items():
            self.tree.add_word(window, (len(window), tuple(ids)))
        if owners:
            self.tree.make_automaton()
        self.empty = not owners

    def scan(self, ws: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged runs of hit words (from, to), and the items that occur."""
        if self.empty or not ws:
            return [], set()
        get = self.number.get
        found: set[str] = set()
        runs: list[list[int]] = []
        for end, (n, ids) in self.tree.iter(tuple([get(w, 0) for w in ws])):
            found.update(ids)
            lo, hi = end - n + 1, end + 1
            while runs and runs[-1][1] >= lo:
                lo = min(lo, runs.pop()[0])
            runs.append([lo, hi])
        return [(a, b) for a, b in runs], found


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """Items in blocks of about ``block_chars`` characters of text, one block at a time on the driver."""
    out, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if out and size + len(row.text) > block_chars:
            yield out
            out, size = [], 0
        out.append((row.item_id, row.text))
        size += len(row.text)
    yield out


_held: dict[str, Scanner] = {}  # of this Python worker: the automaton in use


def _scanner(key: str, block, size: int) -> Scanner:
    if key not in _held:
        _held.clear()
        _held[key] = Scanner(block.value, size)
    return _held[key]


_SPAN = "array<struct<start:long,end:long>>"


def _hits(docs: DataFrame, block, size: int, text: str, only: bool) -> DataFrame:
    """docs with n_words, runs of hit words, items and spans; without the text, and only documents with hits, if ``only``."""
    columns, key = docs.columns, uuid.uuid4().hex
    rest = [c for c in columns if not (only and c == text)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest) + f", n_words long, runs {_SPAN}, items array<string>, spans {_SPAN}"

    def run(batches):
        import pyarrow as pa

        scanner = _scanner(key, block, size)
        pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = batch.column(columns.index(text))
            counts, runs, items, spans = [], [], [], []
            for t in texts:
                t = t.as_py()
                ws = words(t)
                found, ids = scanner.scan(ws)
                found = _merged(found)
                counts.append(len(ws))
                items.append(sorted(ids))
                runs.append([{"start": a, "end": b} for a, b in found])
                at = [m.span() for m in WORD.finditer(lower(t))] if found else []
                spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in found])
            out = pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in rest), pa.array(counts, pa.int64()), pa.array(runs, pairs), pa.array(items, pa.list_(pa.string())), pa.array(spans, pairs)], names=[*rest, "n_words", "runs", "items", "spans"])
            yield out.filter(pa.array([bool(x) for x in runs], pa.bool_())) if only else out

    return map_batches(docs, run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_chars: int = 2_000_000, text: str = "text") -> DataFrame:
    """docs with n_words, n_hit, items (sorted) and spans (hit passages, code points, end exclusive)."""
    docs = give_way(docs, ("n_words", "n_hit", "items", "spans", "runs"))
    columns, context = docs.columns, docs.sparkSession.sparkContext
    parts = blocks(benchmark, block_chars)
    first, second = next(parts), next(parts, None)
    length = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    if second is None:
        return _hits(docs, context.broadcast(first), size, text, False).select(*columns, "n_words", length.alias("n_hit"), "items", "spans")
    held = spill(docs.withColumn("_rid", F.monotonically_increasing_id()), "texts")
    every = None
    for block in (x for some in ([first, second], parts) for x in some):
        shared = context.broadcast(block)
        found = spill(_hits(held.select("_rid", text), shared, size, text, True), "hits")
        every = found if every is None else every.unionByName(found)
        shared.unpersist()
    # pieces of a document are united: a piece starts a run unless it meets what came before
    per = every.groupBy("_rid").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("runs", "spans")))).alias("p"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = "cast(array() as array<struct<runs:struct<start:long,end:long>,spans:struct<start:long,end:long>>>)"
    united = F.expr(
        f"""aggregate(p, {none}, (done, x) -> if(size(done) > 0 and element_at(done, -1).runs.end >= x.runs.start,
            concat(slice(done, 1, size(done) - 1), array(named_struct(
                'runs', named_struct('start', element_at(done, -1).runs.start, 'end', greatest(element_at(done, -1).runs.end, x.runs.end)),
                'spans', named_struct('start', element_at(done, -1).spans.start, 'end', greatest(element_at(done, -1).spans.end, x.spans.end))))),
            concat(done, array(x))))"""
    )
    per = per.withColumn("u", united).select(F.col("_rid").alias("_r"), F.col("u.runs").alias("runs"), F.col("u.spans").alias("spans"), "items")
    out = held.join(per, F.col("_rid") == F.col("_r"), "left")
    empty = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    out = out.select(*columns, empty("items", "array<string>"), empty("spans", _SPAN), empty("runs", _SPAN))
    n_words = F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))).cast("long")
    return out.select(*columns, n_words.alias("n_words"), length.alias("n_hit"), "items", "spans")


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = scan(docs.select("doc_id", "text"), benchmark, **options).drop("text")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones; columns as they are."""
    columns = docs.columns
    names = {c: f"_d_{k}" for k, c in enumerate(columns) if c != "text"}
    out = scan(docs.withColumnsRenamed(names), benchmark, **options).where("n_hit = 0").drop("n_words", "n_hit", "items", "spans")
    return out.withColumnsRenamed({v: k for k, v in names.items()}).select(*columns)

