"""Mixing sources to target weights by min-cost flow (operator 9).

Documents are aggregated by membership pattern: the set of sources in which
their text occurs.  A pattern supplies its words once for each use; the first
use of its distinct texts is free, each further one (a copy in another source,
or a repetition) costs more (convex costs).  A source takes from a pattern at
most ``max_repeats`` times the words that its own documents have there.
Successive shortest paths route this capacity to the source quotas, one
network for each set of sources that patterns tie together; so the sources that
share texts agree on who uses them.  The flow of each (pattern, source) then
becomes documents: whole repetitions for all, and one more for documents in a
seeded order until the rest is used.

The driver holds a row for each (pattern, source), no document.  The seeded
order is cut through histograms of hash cells, each of ``CELLS`` times finer than
the one before, until a cut holds at most ``CUT_ROWS`` rows, and only
those rows are ordered (rows alike in id and text share a cell at any depth).

Nulls: a null text has size 0; a null source is a source of its own, last in
order; a null doc_id is hashed like a value.  Rows with equal doc_id and text
are separate rows whose order between each other doesn't matter.  An empty
table gives an empty result.  Further columns ride along in ``mixed``, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _words as W
from ._shared import bloom, drop, map_batches, maybe_in, spill

SIZES = "doc_id long, source string, size long, text_hash long, text_key string"
CELLS = 4096
DEPTH = 5  # CELLS ** DEPTH cells at most
CUT_ROWS = 10_000
BROADCAST_ROWS = 200_000  # narrow rows of the plan that are broadcast
OFTEN = 1000  # texts that occur so often are joined apart, so that they load no single task


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, text_hash, text_key): one narrow row per document, in one pass over the texts."""

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            data, offs = W.column(batch.column(2))
            n = np.zeros(batch.num_rows, np.int64)
            for lo, hi in W.slices(offs):
                w = W.scan(data, offs, lo, hi, hashed=False)
                n[lo:hi] = np.bincount(w.row, minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), batch.column(3), batch.column(4)], names=["doc_id", "source", "size", "text_hash", "text_key"])

    return map_batches(docs.select("doc_id", "source", "text", *_text_keys()), sizes, SIZES)


def _text_keys() -> list[Column]:
    return [F.xxhash64("text").alias("text_hash"), F.md5(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_key")]


def targets(sizes: dict, weights: dict, most: float = 3.0) -> dict:
    """Quotas: the whole of all sizes shared by weight, none above ``most`` times its source's size.

    What is cut off is shared by weight among the others, again and again.
    """
    total = float(sum(sizes.values()))
    out, open_ = dict.fromkeys(sizes, 0.0), list(sizes)
    left = total
    while open_ and left > 0:
        share = sum(weights[s] for s in open_)
        give = {s: left * weights[s] / share for s in open_}
        full = [s for s in open_ if give[s] > most * sizes[s]]
        if not full:
            out.update(give)
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
    return out


class Flow:
    """Min-cost flow for networks whose only costs are on arcs out of the source.

    There a cheapest path costs as much as its first arc, so successive shortest
    paths take these arcs by rising cost: all of one cost are opened at once and
    filled by blocking flows (Dinic), along residual arcs that cost nothing.
    """

    LEAST = 1e-7

    def __init__(self, n: int):
        self.arcs: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []
        self.closed: dict[float, list[tuple[int, float]]] = {}
        self.first: dict[int, int] = {}

    def add(self, u: int, v: int, room: float) -> int:
        """An arc without cost; its number."""
        k = len(self.to)
        self.to += [v, u]
        self.room += [room, 0.0]
        self.arcs[u].append(k)
        self.arcs[v].append(k + 1)
        return k

    def supply(self, v: int, room: float, cost: float) -> None:
        """Room from the source (node 0) to v at a cost."""
        if v not in self.first:
            self.first[v] = self.add(0, v, 0.0)
        self.closed.setdefault(cost, []).append((self.first[v], room))

    def solve(self) -> None:
        for cost in sorted(self.closed):
            for k, room in self.closed[cost]:
                self.room[k] += room
            while self._blocking():
                pass

    def _blocking(self) -> bool:
        """Fill all shortest residual paths from node 0 to node 1; false if there is none."""
        depth = [-1] * len(self.arcs)
        depth[0], queue = 0, [0]
        for u in queue:
            for k in self.arcs[u]:
                v = self.to[k]
                if depth[v] < 0 and self.room[k] > self.LEAST:
                    depth[v] = depth[u] + 1
                    queue.append(v)
        if depth[1] < 0:
            return False
        at, path = [0] * len(self.arcs), []
        u = 0
        while True:
            if u == 1:
                push = min(self.room[k] for k in path)
                for k in path:
                    self.room[k] -= push
                    self.room[k ^ 1] += push
                cut = next(i for i, k in enumerate(path) if self.room[k] <= self.LEAST)
                u = self.to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[u] < len(self.arcs[u]):
                k = self.arcs[u][at[u]]
                if self.room[k] > self.LEAST and depth[self.to[k]] == depth[u] + 1:
                    path.append(k)
                    u = self.to[k]
                    break
                at[u] += 1
            else:
                if not path:
                    return True
                k = path.pop()
                u = self.to[k ^ 1]
                at[u] += 1


def route(patterns: dict[tuple, tuple[float, dict]], quota: dict, max_repeats: int = 3) -> dict[tuple, dict]:
    """Words that each pattern gives to each of its sources.

    patterns: tuple of sources to (words of its distinct texts, words by
    source).  Uses 1, 2, 3, 4 of the distinct texts cost 0, 1, 4, 9; further
    ones come in steps of 4, 8, ... uses at the cost of the step's first.
    """
    out: dict[tuple, dict] = {}
    for names, sources in _networks(patterns):
        flow, at = Flow(2 + len(names) + len(sources)), {s: 2 + len(names) + k for k, s in enumerate(sources)}
        used = []
        for i, p in enumerate(names):
            once, words = patterns[p]
            left, use, width = max_repeats * sum(words.values()), 0, 1
            while left > 0 and once > 0:
                room = min(left, width * once)
                flow.supply(2 + i, float(room), float(use * use))
                left -= room
                use += width
                width = 1 if use < 4 else use
            used.append([(s, flow.add(2 + i, at[s], float(max_repeats * words[s]))) for s in p])
        for s in sources:
            flow.add(at[s], 1, float(quota[s]))
        flow.solve()
        out |= {p: {s: flow.room[k ^ 1] for s, k in used[i]} for i, p in enumerate(names)}
    return out


def _networks(patterns: dict) -> list[tuple[list, list]]:
    """Patterns and sources in groups that no pattern ties together."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for p in patterns:
        for s in p[1:]:
            parent[find(p[0])] = find(s)
    groups: dict = {}
    for p in patterns:
        groups.setdefault(find(p[0]), []).append(p)
    return [(names, list(dict.fromkeys(s for p in names for s in p))) for names in groups.values()]


@dataclass
class Plan:
    """Of each (source, pattern): the source's size and target, whole repetitions, the places (from, to) in the seeded
    order between which the extra one ends, and the words left there."""

    rows: list[tuple]

    def table(self, spark) -> DataFrame:
        """The rows, broadcast where they are few; more are joined by shuffle."""
        out = spark.createDataFrame(self.rows, "plan_source string, plan_pattern string, source_size long, target double, whole int, cut_from long, cut_to long, rest double")
        return F.broadcast(out) if len(self.rows) <= BROADCAST_ROWS else out


def _place(seed: int) -> Column:
    """Place of a row in the seeded order, from 0 to CELLS ** DEPTH."""
    return F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.lit(CELLS**DEPTH))


def shared_texts(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts: distinct ones by source where that is one; shared: text_key, times and pattern of those in several)."""
    of = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))  # a null source is a source too
    # a row for each text and source first, however often the text occurs there
    pairs = spill(sized.groupBy("text_key", of.alias("of")).agg(F.max("size").alias("size"), F.count("*").alias("times")), "pairs")
    texts = spill(pairs.groupBy("text_key").agg(F.min("of").alias("low"), F.max("of").alias("high"), F.max("size").alias("size"), F.sum("times").alias("times")), "texts")
    keys = texts.where("low <> high").select("text_key", "size", "times")
    sets = pairs.join(keys.select(F.col("text_key").alias("_t")), F.col("text_key") == F.col("_t"), "left_semi").groupBy("text_key").agg(F.array_sort(F.collect_set("of")).alias("of"))
    shared = keys.join(sets.withColumnRenamed("text_key", "_t"), F.col("text_key") == F.col("_t")).select("text_key", "size", "times", F.to_json("of").alias("pattern"))
    return texts, spill(shared, "shared")


def with_pattern(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """rows (with text_key) with ``pattern``: null where the text occurs in one source only."""
    if shared.isEmpty():
        return rows.withColumn("pattern", F.lit(None).cast("string"))
    of = lambda d: d.select(F.col("text_key").alias("_t"), "pattern")
    marked = maybe_in(rows.withColumn("_key", F.xxhash64("text_key")), "_key", bloom(shared.select(F.xxhash64("text_key").alias("_key")), "_key")).drop("_key")
    often = spill(of(shared.where(F.col("times") >= OFTEN)), "often")
    some = marked.where("_maybe").drop("_maybe").join(often, F.col("text_key") == F.col("_t"), "left").drop("_t")
    ready, rest = some.where("pattern is not null"), some.where("pattern is null").drop("pattern")
    rest = rest.join(of(shared.where(F.col("times") < OFTEN)), F.col("text_key") == F.col("_t"), "left").drop("_t")
    return marked.where("not _maybe").drop("_maybe").withColumn("pattern", F.lit(None).cast("string")).unionByName(ready).unionByName(rest)


def plan(sized: DataFrame, weights: dict | None = None, max_repeats: int = 3, seed: int = 0) -> tuple[Plan, DataFrame]:
    """Solve the flow over sized rows (see SIZES); also the texts that occur in several sources."""
    import json

    texts, shared = shared_texts(sized)
    rows = with_pattern(sized, shared)
    per = rows.groupBy("source", "pattern").agg(F.sum("size").alias("size")).collect()
    per.sort(key=lambda r: (r.source is None, r.source or "", r.pattern or ""))  # among flows of equal cost the order decides
    sizes: dict = {}
    for r in per:
        sizes[r.source] = sizes.get(r.source, 0) + int(r["size"])
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weights = weights or {s: 1 + k % 3 for k, s in enumerate(order)}
    quota = targets(sizes, weights, max_repeats)
    name = lambda x: None if x == "n" else x[1:]
    once = {(name(r.low),): int(r["size"]) for r in texts.where("low = high").groupBy("low").agg(F.sum("size").alias("size")).collect()}
    once |= {tuple(map(name, json.loads(r.pattern))): int(r["size"]) for r in shared.groupBy("pattern").agg(F.sum("size").alias("size")).collect()}
    drop(texts)
    patterns: dict = {}
    for r in per:
        p = (r.source,) if r.pattern is None else tuple(map(name, json.loads(r.pattern)))
        patterns.setdefault(p, (once[p], {}))[1][r.source] = int(r["size"])
    given = route(patterns, quota, max_repeats)
    made = []
    for r in per:
        p, n = (r.source,) if r.pattern is None else tuple(map(name, json.loads(r.pattern))), int(r["size"])
        whole = min(max_repeats, int(given[p][r.source] // n)) if n else 0
        rest = max(0.0, given[p][r.source] - whole * n) if whole < max_repeats else 0.0
        made.append((r.source, r.pattern, sizes[r.source], quota[r.source], whole, 0, CELLS**DEPTH, rest))
    return Plan(_cut(rows, made, seed)), shared


def _cut(rows: DataFrame, made: list[tuple], seed: int) -> list[tuple]:
    """made with the places between which the seeded order reaches the rest, narrowed until they hold few rows."""
    live = {(r[0], r[1]) for r in made if r[-1] > 0}
    cuts = {(r[0], r[1]): r for r in made}
    for key, r in cuts.items():
        if key not in live:
            cuts[key] = (*r[:5], 0, 0, 0.0)
    for depth in range(DEPTH):
        if not live:
            break
        wide = CELLS ** (DEPTH - 1 - depth)
        table = Plan([cuts[k] for k in sorted(live, key=str)]).table(rows.sparkSession)
        place = rows.withColumn("_place", _place(seed)).join(table, _same()).where("_place >= cut_from and _place < cut_to")
        cells = place.groupBy("plan_source", "plan_pattern", F.expr(f"cut_from + (_place - cut_from) div {wide}L * {wide}L").alias("cell"), "rest").agg(F.sum("size").alias("cell_size"), F.count("*").alias("cell_rows"))
        upto = F.sum("cell_size").over(Window.partitionBy("plan_source", "plan_pattern").orderBy("cell"))
        found = cells.withColumn("before", upto - F.col("cell_size")).where("before < rest and before + cell_size >= rest")
        found = {(r.plan_source, r.plan_pattern): r["at"] for r in found.groupBy("plan_source", "plan_pattern").agg(F.min(F.struct("cell", "before", "cell_rows")).alias("at")).collect()}
        for key in list(live):
            r = cuts[key]
            if key not in found:  # rounding: all are taken
                cuts[key] = (*r[:5], r[6], r[6], 0.0)
                live.discard(key)
                continue
            at = found[key]
            cuts[key] = (*r[:5], at["cell"], at["cell"] + wide, r[7] - at["before"])
            if at["cell_rows"] <= CUT_ROWS:
                live.discard(key)
    return list(cuts.values())


def _same() -> Column:
    return F.col("source").eqNullSafe(F.col("plan_source")) & F.col("pattern").eqNullSafe(F.col("plan_pattern"))


def apply(rows: DataFrame, made: Plan, seed: int = 0, size: Column | None = None) -> DataFrame:
    """rows (doc_id, source, text_hash, pattern, size and any others) with source_size, target, repeats and taken.

    Only rows of the cuts (at most CUT_ROWS for each pattern and source) are
    shuffled and ordered.  ``size`` gives the size of those where rows have none.
    """
    rows = rows.withColumn("_place", _place(seed)).join(made.table(rows.sparkSession), _same())
    inside = (F.col("_place") >= F.col("cut_from")) & (F.col("_place") < F.col("cut_to"))
    if size is not None:
        rows = rows.withColumn("size", F.when(inside, size).otherwise(0).cast("long"))
    easy = rows.where(~inside).withColumn("repeats", F.col("whole") + (F.col("_place") < F.col("cut_from")).cast("int"))
    within = Window.partitionBy("plan_source", "plan_pattern").orderBy("_place", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.where(inside).withColumn("_reach", F.sum("size").over(within))
    cut = cut.withColumn("repeats", F.col("whole") + (F.col("_reach") - F.col("size") / 2 <= F.col("rest")).cast("int")).drop("_reach")
    out = easy.unionByName(cut).withColumn("taken", F.col("repeats") * F.col("size"))
    return out.drop("_place", "plan_source", "plan_pattern", "whole", "cut_from", "cut_to", "rest", "pattern", "text_key")


def mix(docs: DataFrame, weights: dict | None = None, max_repeats: int = 3, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats, taken) of every row of docs.

    weights: by source (None for null); unset: 1, 2, 3 repeating over the
    sources in code-point order, null last.
    """
    sized = spill(word_counts(docs), "sizes")
    made, shared = plan(sized, weights, max_repeats, seed)
    return apply(with_pattern(sized, shared), made, seed).drop("text_hash")


def mixed(docs: DataFrame, weights: dict | None = None, max_repeats: int = 3, seed: int = 0) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, columns as they are."""
    sized = spill(word_counts(docs), "sizes")
    made, shared = plan(sized, weights, max_repeats, seed)
    drop(sized)
    names = {c: f"_loom_d{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "source", "text")}
    rows = docs.withColumnsRenamed(names).select("*", *_text_keys())
    # the flow's order needs sizes only within the cuts
    size = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    out = apply(with_pattern(rows, shared), made, seed, size).where("repeats > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "repeats")))
    # the mix's own columns go before docs' columns get their names back
    return out.select(*[names.get(c, c) for c in docs.columns]).withColumnsRenamed({v: k for k, v in names.items()})
