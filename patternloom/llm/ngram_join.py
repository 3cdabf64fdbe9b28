"""N-gram Jaccard join through a count-vector R-tree (operator 4).

Exact links between documents whose sets of 5-word shingles have a Jaccard
similarity of at least 0.8, as connected components.

1. One pass over the texts counts shingle hashes into a fixed sketch; buckets
   far above the mean mark frequent shingles (boilerplate, large groups of
   copies).  They come last in the order of shingles, which only moves work.
2. A second pass gives each document a 128-bit digest of its words (equal
   words collapse to one node), the prefix of its ordered set (two similar
   sets share a prefix shingle), two min-hash keys, and its count vector:
   shingles hashed into ``GROUPS`` groups.
3. Nodes that share a key form a run.  Within a run an R-tree over count
   vectors (bulk-loaded by halving at the widest coordinate) bounds the
   overlap of boxes, then of points, by summed coordinate minima; pairs that
   could reach 0.8 survive, in the second step also by finer vectors, and are
   verified on the words themselves.  A run that fits a leaf is a tree of one
   leaf; many such are joined at once.  First the runs of min-hash keys: they
   link most of each group of near copies.  Then, so that no link between
   components is lost, the runs of all prefix shingles on which different
   components meet.

No task holds an unbounded run.  A run of a min-hash key above ``CELL``
shingles' weight is dealt to cells that share two centres.  A run of a prefix
shingle above it needs only pairs of different components: blocks of members
outside its largest component meet blocks of all, so the work is linear in a
large group that is one component already.  Only words of surviving candidates
are shuffled.  A run yields at most a forest of links, never all pairs.
Intermediate tables are deleted as soon as the next one is written.

Hashes (64 bits, each word and shingle mixed in, nothing that adds up) find
candidates and count a document's shingles; they never make a link.

Nulls: a null text, or one without words, has an empty set and links with
nothing; rows with a null doc_id are left out of links and have a null
component.  Rows that repeat a doc_id are one vertex of the graph.  Ties: the
smallest doc_id names the component, whatever the order of rows.  An empty
table gives an empty result.  Further columns of docs, whatever their names,
don't matter to ``join`` and are kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _words as W
from ._shared import bloom, components, drop, map_batches, maybe_in, places_set, spill, with_places

SHINGLE = 5
GROUPS = 64
SKETCH_BITS = 20
SKETCH_BLOCK = 4096
CELL = 4096  # weight of a cell: 1 for a member, and 1 for each 512 of its shingles
LEAF = 32  # a run up to this size is a tree of one leaf

SIGNATURE = "rid long, doc_id long, n long, fp1 long, fp2 long, prefix array<long>, counts binary, keys array<long>"


def shingle_hashes(data: np.ndarray, offs: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(row from lo, hash) of each shingle of the rows; a text of fewer words has its whole sequence."""
    w = W.scan(data, offs, lo, hi, W.NOT_SPACE, lower=True)
    at, h = W.windows(w, SHINGLE)
    rows = w.row[at]
    b = w.bounds()
    short = np.flatnonzero((np.diff(b) > 0) & (np.diff(b) < SHINGLE))
    if len(short):
        more = np.empty(len(short), np.uint64)
        for k, r in enumerate(short):
            piece = W.Words(0, 1, np.zeros(b[r + 1] - b[r], np.int64), w.start[b[r] : b[r + 1]], w.end[b[r] : b[r + 1]], w.hash[b[r] : b[r + 1]])
            more[k] = W.windows(piece, int(b[r + 1] - b[r]))[1][0]
        rows, h = np.concatenate([rows, short]), np.concatenate([h, more])
    return rows, h


def sets(data: np.ndarray, offs: np.ndarray, lo: int, hi: int, hot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row in order (frequent ones last): bounds by row, keys, and hashes."""
    rows, h = shingle_hashes(data, offs, lo, hi)
    key = h >> np.uint64(1)
    if hot is not None:
        key |= hot[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(63)
    order = np.lexsort((key, rows))
    rows, key, h = rows[order], key[order], h[order]
    if len(rows):
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:] != rows[:-1]) | (key[1:] != key[:-1])
        rows, key, h = rows[first], key[first], h[first]
    return np.searchsorted(rows, np.arange(hi - lo + 1)), key, h


def hot_buckets(docs: DataFrame) -> np.ndarray:
    """Sketch buckets of frequent shingles as booleans; counts are summed over all texts, the result has a fixed size."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            data, offs = W.column(batch.column(0))
            for lo, hi in W.slices(offs):
                _, h = shingle_hashes(data, offs, lo, hi)
                total += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        blocks = total.astype("<u4").reshape(-1, SKETCH_BLOCK)
        some = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([blocks[b].tobytes() for b in some], pa.binary())], names=["block", "counts"])

    def total(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[b] = sums.get(b, 0) + np.frombuffer(raw.as_buffer(), "<u4").astype(np.int64)
        out = []
        for c in sums.values():
            mean = c.mean()
            out.append(np.packbits(c > mean + 8 * np.sqrt(mean) + 100).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(out, pa.binary())], names=["block", "bits"])

    parts = map_batches(map_batches(docs.select("text"), count, "block int, counts binary").repartition("block"), total, "block int, bits binary").collect()
    hot = np.zeros(1 << SKETCH_BITS, bool)
    for r in parts:
        hot[r.block * SKETCH_BLOCK : (r.block + 1) * SKETCH_BLOCK] = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8)).astype(bool)
    return hot


def signatures(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(hot))

    def run(batches):
        import pyarrow as pa

        hot = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            data, offs = W.column(batch.column(2))
            for lo, hi in W.slices(offs):
                b, key, h = sets(data, offs, lo, hi, hot)
                digests = b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in W.normalised(data, offs, lo, hi))
                n, rows = np.diff(b), hi - lo
                row = np.repeat(np.arange(rows), n)
                full = np.flatnonzero(n)
                fp = np.frombuffer(digests, "<u8").reshape(rows, 2).T
                keys = np.zeros((2, rows), np.uint64)
                is_hot = key >> np.uint64(63) == 1
                if len(full):
                    top = np.uint64(0xFFFFFFFFFFFFFFFF)
                    mostly = np.bincount(row[is_hot], minlength=rows) * 2 > n
                    for k in range(2):
                        # of rare shingles; the second key of mostly frequent sets is of frequent ones
                        use = np.where(mostly[row], is_hot == (k == 1), ~is_hot)
                        keys[k, full] = np.minimum.reduceat(np.where(use, W.mix(h, 21 + k), top), b[full])
                        keys[k][keys[k] == top] = W.mix(fp[0] + np.uint64(k))[keys[k] == top]
                group = (W.mix(h, 31) >> np.uint64(64 - 6)).astype(np.int64)
                counts = np.bincount(row * GROUPS + group, minlength=rows * GROUPS).reshape(rows, GROUPS)
                size = n - (4 * n + 4) // 5 + 1
                size[n == 0] = 0
                at = np.repeat(b[:-1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(key[at].view(np.int64)))
                pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * rows + 1, 2).astype(np.int32)), pa.array(keys.T.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows), batch.column(1).slice(lo, rows), pa.array(n), pa.array(fp[0].astype(np.int64)), pa.array(fp[1].astype(np.int64)), lists, pa.array([c.astype(_width(m)).tobytes() for c, m in zip(counts, n.tolist(), strict=True)], pa.binary()), pairs],
                    names=["rid", "doc_id", "n", "fp1", "fp2", "prefix", "counts", "keys"],
                )

    return map_batches(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), run, SIGNATURE)


def _width(n: int) -> str:
    """Type of the counts of a set of n shingles: no count exceeds n."""
    return "<u1" if n < 1 << 8 else "<u2" if n < 1 << 16 else "<u4"


def _points(column, n: np.ndarray) -> np.ndarray:
    """Count vectors of members with n shingles, from a binary column."""
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int32)[column.offset : column.offset + len(column)].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    out = np.zeros((len(n), GROUPS), np.int32)
    for low, high, width in ((0, 1 << 8, 1), (1 << 8, 1 << 16, 2), (1 << 16, 1 << 62, 4)):
        k = np.flatnonzero((n >= low) & (n < high))
        if len(k):
            out[k] = data[at[k, None] + np.arange(GROUPS * width)].reshape(-1).view(f"<u{width}").reshape(len(k), GROUPS)
    return out


# ---------------------------------------------------------------- R-tree


class RTree:
    """Bulk-loaded tree of boxes over count vectors: members are halved at the median of the widest coordinate (size
    among them) until a leaf is left, so neighbouring leaves, and the boxes above them, are near in all coordinates."""

    FAN = 8

    def __init__(self, points: np.ndarray, n: np.ndarray):
        """points (members by groups) with sizes n."""
        self.order = self._halved(points, n)
        points, n = points[self.order], n[self.order]
        self.points, self.n = points, n
        self.levels = []  # (high, low size, high size) of boxes, leaves first
        hi, a, z, step = points, n, n, LEAF
        while True:
            cut = np.arange(0, len(a), step)
            hi, a, z = np.maximum.reduceat(hi, cut), np.minimum.reduceat(a, cut), np.maximum.reduceat(z, cut)
            self.levels.append((hi, a, z))
            if len(a) == 1:
                break
            step = self.FAN

    @staticmethod
    def _halved(points: np.ndarray, n: np.ndarray) -> np.ndarray:
        out, todo = [], [np.arange(len(n))]
        while todo:
            some = todo.pop()
            if len(some) <= LEAF:
                out.append(some)
                continue
            wide = points[some]
            spread = wide.max(0) - wide.min(0)
            by = n[some] if np.ptp(n[some]) > spread.max() * 2 else wide[:, int(spread.argmax())]
            some = some[np.argsort(by, kind="stable")]
            half = (len(some) // 2 + LEAF - 1) // LEAF * LEAF  # leaves stay whole
            todo += [some[half:], some[:half]]
        return np.concatenate(out)

    @staticmethod
    def _could(u: np.ndarray, a_low, a_high, b_low, b_high) -> np.ndarray:
        """Whether sets with overlap up to u and sizes in these ranges can reach 0.8."""
        return (9 * u >= 4 * (a_low + b_low)) & (5 * a_high >= 4 * b_low) & (5 * b_high >= 4 * a_low)

    def pairs(self, comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different components whose summed minima allow 0.8, in pieces."""
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, x, y = stack.pop()
            if len(x) > 4096:
                for k in range(0, len(x), 4096):
                    stack.append((level, x[k : k + 4096], y[k : k + 4096]))
                continue
            hi, a, z = self.levels[level]
            ok = self._could(np.minimum(hi[x], hi[y]).sum(1), a[x], z[x], a[y], z[y])
            x, y = x[ok], y[ok]
            if not len(x):
                continue
            if level:
                count = len(self.levels[level - 1][1])
                cx = x[:, None] * self.FAN + np.arange(self.FAN)
                cy = y[:, None] * self.FAN + np.arange(self.FAN)
                px, py = np.repeat(cx, self.FAN, 1).ravel(), np.tile(cy, (1, self.FAN)).ravel()
                keep = (px < count) & (py < count) & (px <= py)
                stack.append((level - 1, px[keep], py[keep]))
                continue
            for k in range(0, len(x), 16):
                i = (x[k : k + 16, None] * LEAF + np.arange(LEAF))[:, :, None]
                j = (y[k : k + 16, None] * LEAF + np.arange(LEAF))[:, None, :]
                i, j = np.broadcast_arrays(i, j)
                keep = (i < j) & (j < len(self.n))
                i, j = i[keep], j[keep]
                keep = comp[self.order[i]] != comp[self.order[j]]
                i, j = i[keep], j[keep]
                ok = self._could(np.minimum(self.points[i], self.points[j]).sum(1), self.n[i], self.n[i], self.n[j], self.n[j])
                if ok.any():
                    yield self.order[i[ok]], self.order[j[ok]]


def runs_of(batches):
    """Columns of each run of rows with equal (key, cell), from sorted Arrow batches; small runs come many at once."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(0).to_numpy()
        c = batch.column(1).to_numpy()
        new = np.flatnonzero((k[1:] != k[:-1]) | (c[1:] != c[:-1]))
        if not len(new):
            if held and (held[-1].column(0)[-1] != batch.column(0)[0] or held[-1].column(1)[-1] != batch.column(1)[0]):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch)
            continue
        last = int(new[-1]) + 1
        held.append(batch.slice(0, last))
        yield pa.Table.from_batches(held).combine_chunks()
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _bounds(t) -> np.ndarray:
    k, c = t.column(0).to_numpy(), t.column(1).to_numpy()
    return np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]) | (c[1:] != c[:-1])) + 1, [len(k)]])


_WEIGHT = "1 + n div 512"


def _heavy(rows: DataFrame) -> DataFrame:
    """(_key, _w, _low, _high): weight and outermost nodes of the keys above CELL."""
    return rows.groupBy("key").agg(F.sum(F.expr(_WEIGHT)).alias("_w"), F.min("node").alias("_low"), F.max("node").alias("_high")).where(F.col("_w") > CELL).withColumnRenamed("key", "_key")


def _block(by: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(by))


def in_stars(rows: DataFrame) -> DataFrame:
    """rows with ``cell``: a run above CELL is dealt to cells of about that weight; its outermost nodes go to each."""
    big = spill(_heavy(rows).withColumn("_b", F.ceil(F.col("_w") / CELL).cast("long")), "heavy")
    if big.isEmpty():
        return rows.withColumn("cell", F.lit(0).cast("long"))
    out = rows.join(big, F.col("key") == F.col("_key"), "left")
    cells = F.when(F.col("node").isin(F.col("_low"), F.col("_high")), F.expr("sequence(0L, _b - 1)")).otherwise(F.array(_block("_b")))
    return out.withColumn("cell", F.explode(F.when(F.col("_b").isNull(), F.array(F.lit(0).cast("long"))).otherwise(cells))).drop(*big.columns)


def in_cells(rows: DataFrame) -> DataFrame:
    """rows with ``cell``: of a run above CELL, blocks of the members outside its largest component meet blocks of all
    members, so each pair of different components is in a cell; a cell weighs at most about twice CELL."""
    big = spill(_heavy(rows).select("_key", "_w"), "heavy")
    if big.isEmpty():
        return rows.withColumn("cell", F.lit(0).cast("long"))
    each = rows.join(big, F.col("key") == F.col("_key")).groupBy("_key", "_w", "comp").agg(F.sum(F.expr(_WEIGHT)).alias("_c"))
    top = each.groupBy(F.col("_key").alias("_k"), "_w").agg(F.max(F.struct("_c", "comp")).alias("_top"))
    top = top.select("_k", F.ceil(F.col("_w") / CELL).cast("long").alias("_all"), F.ceil((F.col("_w") - F.col("_top._c")) / CELL).cast("long").alias("_few"), F.col("_top.comp").alias("_main"))
    out = rows.join(top, F.col("key") == F.col("_k"), "left").withColumns({"_i": _block("_all"), "_j": F.pmod(F.xxhash64("node", F.lit(1)), F.col("_few"))})
    mine = F.expr("transform(sequence(0L, _few - 1), j -> _i * _few + j)")
    more = F.expr("transform(sequence(0L, _all - 1), i -> i * _few + _j)")
    cells = F.when(F.col("_few") == 0, F.array(F.lit(0).cast("long"))).when(F.col("comp") == F.col("_main"), mine).otherwise(F.array_union(mine, more))
    out = out.withColumn("cell", F.explode(F.when(F.col("_all").isNull(), F.array(F.lit(0).cast("long"))).otherwise(cells)))
    return out.drop("_k", "_all", "_few", "_main", "_i", "_j")


FOUND = "u long, v long, key long, cell long, node long, comp long"


def _found(u, v, m, key, cell, node, comp):
    """A batch of pairs (u, v), then of members m."""
    import pyarrow as pa

    def column(first, rest, kind):
        return pa.concat_arrays([first if first is not None else pa.nulls(len(u), kind), pa.array(rest, kind) if rest is not None else pa.nulls(len(m), kind)])

    long = pa.int64()
    return pa.RecordBatch.from_arrays(
        [column(pa.array(np.minimum(u, v), long), None, long), column(pa.array(np.maximum(u, v), long), None, long), column(None, key[m], long), column(None, cell[m], long), column(None, node[m], long), column(None, comp[m], long)],
        names=["u", "v", "key", "cell", "node", "comp"],
    )


def candidates(rows: DataFrame) -> DataFrame:
    """From runs (key, cell, node, comp, n, counts), wherever the R-tree leaves a pair of different components: pairs
    (u, v) of runs that fit a leaf, and members (key, cell, node, comp) of larger ones."""
    rows = rows.select("key", "cell", "node", "comp", "n", "counts").repartition("key", "cell").sortWithinPartitions("key", "cell", "n", "node")

    def run(batches):
        for t in runs_of(batches):
            b = _bounds(t)
            key, cell, node, comp, n = (t.column(k).to_numpy() for k in range(5))
            points = _points(t.column(5).combine_chunks(), n)
            size = np.diff(b)
            us, vs, members = [], [], []
            leaf = np.repeat(size <= LEAF, size)
            of = np.repeat(np.arange(len(size)), size)
            for d in range(1, min(LEAF, len(n))):
                i = np.flatnonzero(leaf[:-d] & (of[d:] == of[:-d]) & (comp[d:] != comp[:-d]))
                for k in range(0, len(i), 4096):
                    x, y = i[k : k + 4096], i[k : k + 4096] + d
                    ok = RTree._could(np.minimum(points[x], points[y]).sum(1), n[x], n[x], n[y], n[y])
                    us.append(node[x[ok]])
                    vs.append(node[y[ok]])
            for r in np.flatnonzero(size > LEAF):
                s = slice(b[r], b[r + 1])
                if (comp[s] == comp[b[r]]).all():
                    continue
                marked = np.zeros(size[r], bool)
                for i, j in RTree(points[s], n[s]).pairs(comp[s]):
                    marked[i] = marked[j] = True
                members.append(b[r] + np.flatnonzero(marked))
            u = np.concatenate(us) if us else np.zeros(0, np.int64)
            v = np.concatenate(vs) if vs else np.zeros(0, np.int64)
            m = np.concatenate(members) if members else np.zeros(0, np.int64)
            yield _found(u, v, m, key, cell, node, comp)

    return spill(map_batches(rows, run, FOUND), "candidates")


def as_runs(found: DataFrame) -> DataFrame:
    """(key, cell, node, comp) of ``candidates``, where a pair is a run of two."""
    pairs = found.where("u is not null").select("u", "v").distinct()
    p = pairs.select(F.xxhash64("u", "v").alias("key"), F.lit(-1).cast("long").alias("cell"), F.explode(F.array("u", "v")).alias("node")).withColumn("comp", F.col("node"))
    out = spill(p.unionByName(found.where("node is not null").select("key", "cell", "node", "comp")), "todo")
    drop(found)
    return out


def fetched(docs: DataFrame, todo: DataFrame, make, value: str) -> DataFrame:
    """todo with n and ``value``: make(data, offsets, lo, hi) gives shingle counts and values of rows lo..hi, in one pass
    over the texts.  A bloom filter of fixed size keeps documents that aren't asked for from being shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom(todo.select("node").distinct(), "node"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            batch = batch.filter(pa.array(places_set(batch, shared.value)))
            data, offs = W.column(batch.column(1))
            for lo, hi in W.slices(offs):
                n, made = make(data, offs, lo, hi)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "n", value])

    have = map_batches(with_places(docs.select("doc_id", "text"), "doc_id"), run, f"doc_id long, n long, {value} binary")
    return todo.join(have, F.col("node") == F.col("doc_id")).select("key", "cell", "node", "comp", "n", value)


def fine_groups(n: int) -> int:
    """Groups of a set of n shingles at the fine level: about one for four shingles."""
    return 1 << min(12, max(6, int(n // 4).bit_length()))


def fine_counts(h: np.ndarray) -> bytes:
    g = fine_groups(len(h))
    at = (W.mix(h, 31) >> np.uint64(64 - (g.bit_length() - 1))).astype(np.int64)
    return np.bincount(at, minlength=g).astype("<u4" if len(h) > 65_535 else "<u2").tobytes()


def _fine(data, offs, lo, hi):
    b, _, h = sets(data, offs, lo, hi, None)
    return np.diff(b), [fine_counts(h[b[r] : b[r + 1]]) for r in range(hi - lo)]


def _words(data, offs, lo, hi):
    words = W.normalised(data, offs, lo, hi)
    return np.array([len(x) for x in words], np.int64), words


def refined(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates that also pass the bound over finer count vectors, whose groups follow the size of the set:
    long sets need more coordinates before summed minima tell them apart."""
    todo = as_runs(found)
    rows = fetched(docs, todo, _fine, "fine").repartition("key", "cell").sortWithinPartitions("key", "cell", "n", "node")

    def run(batches):
        import pyarrow as pa

        for t in runs_of(batches):
            b = _bounds(t)
            key, cell, node, comp, n = (t.column(k).to_numpy() for k in range(5))
            raw = t.column(5)
            us, vs, ms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for r in range(len(b) - 1):
                s, f = b[r], b[r + 1] - b[r]
                i, j = _fine_pairs([raw[k].as_buffer() for k in range(s, s + f)], n[s : s + f], comp[s : s + f])
                if len(i) <= 8 * f:
                    us.append(node[s + i])
                    vs.append(node[s + j])
                else:
                    ms.append(s + np.unique(np.concatenate([i, j])))
            yield _found(np.concatenate(us), np.concatenate(vs), np.concatenate(ms), key, cell, node, comp)

    out = spill(map_batches(rows, run, FOUND), "refined")
    drop(todo)
    return out


def _fine_pairs(raw: list, n: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of different components that pass the fine bound; members are sorted by n."""
    by_groups: dict[int, list[int]] = {}
    for k, size in enumerate(n.tolist()):
        by_groups.setdefault(fine_groups(size), []).append(k)
    read = {g: np.stack([np.frombuffer(raw[k], "<u4" if n[k] > 65_535 else "<u2").astype(np.int32) for k in ks]) for g, ks in by_groups.items()}
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for g, ks in by_groups.items():
        own = np.array(ks)
        sides = [(own, read[g], True)]
        if 2 * g in by_groups:  # sets of 0.8 have as many groups, or twice as many
            sides.append((np.array(by_groups[2 * g]), read[2 * g].reshape(len(by_groups[2 * g]), g, 2).sum(2), False))
        for other, vectors, same in sides:
            for x, k in enumerate(own.tolist()):
                lo = x + 1 if same else 0
                hi = int(np.searchsorted(n[other], n[k] * 5 // 4, side="right"))
                js = np.arange(lo, max(lo, hi))
                js = js[comp[other[js]] != comp[k]]
                for part in range(0, len(js), 2048):
                    y = js[part : part + 2048]
                    y = y[9 * np.minimum(read[g][x], vectors[y]).sum(1) >= 4 * (n[k] + n[other[y]])]
                    out_i.append(np.full(len(y), k))
                    out_j.append(other[y])
    i, j = np.concatenate(out_i), np.concatenate(out_j)
    return np.minimum(i, j), np.maximum(i, j)


def exact(words: bytes) -> set:
    """Shingles of normalised words, by content."""
    w = words.split(b" ")
    return {tuple(w)} if len(w) < SHINGLE else set(zip(*(w[k:] for k in range(SHINGLE)), strict=False))


def linked(a: set, b: set) -> bool:
    o = len(a & b)
    return 100 * o >= 80 * (len(a) + len(b) - o)


def verified(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Links (u, v): pairs verified on their words, and for each run of members a forest of its links."""
    todo = as_runs(found)
    rows = fetched(docs, todo, _words, "words").drop("n")
    rows = rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "node")

    def run(batches):
        import pyarrow as pa

        for t in runs_of(batches):
            b = _bounds(t)
            node, comp = t.column(2).to_numpy(), t.column(3).to_numpy()
            data, offs = W.column(t.column(4))
            us, vs = [], []
            first = 0
            while first < len(b) - 1:
                # as many whole runs as a block has room for
                last = max(first + 1, int(np.searchsorted(offs[b], offs[b[first]] + W.BLOCK, side="right")) - 1)
                shingles: list[np.ndarray] = []
                lo, hi = int(b[first]), int(b[last])
                for x, z in W.slices(offs[lo : hi + 1]):
                    e, _, h = sets(data, offs, lo + x, lo + z, None)
                    shingles += [h[e[k] : e[k + 1]] for k in range(z - x)]
                for r in range(first, last):
                    held: dict[int, set] = {}

                    def of(i: int, held=held, start=int(b[r])) -> set:
                        if i not in held:
                            if len(held) > 8:  # the centre of a star is asked for all the time, others once
                                held.pop(next(iter(list(held)[1:])))
                            held[i] = exact(data[offs[start + i] : offs[start + i + 1]].tobytes())
                        return held[i]

                    for i, j in forest(shingles[b[r] - lo : b[r + 1] - lo], comp[b[r] : b[r + 1]], lambda i, j, of=of: linked(of(i), of(j))):
                        us.append(int(node[b[r] + i]))
                        vs.append(int(node[b[r] + j]))
                first = last
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    out = spill(map_batches(rows, run, "u long, v long").where("u <> v").distinct(), "links")
    drop(todo)
    return out


def forest(members: list[np.ndarray], comp: np.ndarray, confirm=lambda i, j: True) -> list[tuple[int, int]]:
    """Links that join all members which links of 0.8 join, starting from the given components; of pairs whose hashes
    agree so far, those that ``confirm`` by content."""
    f, n = len(members), np.array([len(m) for m in members], np.int64)
    if f == 2:
        o = len(np.intersect1d(members[0], members[1], assume_unique=True))
        return [(0, 1)] if o and 9 * o >= 4 * (n[0] + n[1]) and confirm(0, 1) else []
    root = np.unique(comp, return_inverse=True)[1]
    token = np.unique(np.concatenate(members), return_inverse=True)[1]
    owner = np.repeat(np.arange(f), n)
    df = np.bincount(token)
    by_token = owner[np.argsort(token, kind="stable")]
    start = np.cumsum(df) - df
    first = np.cumsum(n) - n
    # the most central member first: it links most others at once
    weight = np.bincount(owner, weights=df[token], minlength=f) / np.maximum(n, 1)
    out = []
    for i in np.argsort(-weight, kind="stable").tolist():
        if (root == root[0]).all():
            break
        mine = token[first[i] : first[i] + n[i]]
        mine = mine[df[mine] > 1]
        if not len(mine):
            continue
        size = df[mine]
        at = np.repeat(start[mine], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        o = np.bincount(by_token[at], minlength=f)
        for j in np.flatnonzero((9 * o >= 4 * (n + n[i])) & (root != root[i])).tolist():
            if root[j] != root[i] and confirm(i, j):
                out.append((i, j))
                root[root == root[j]] = root[i]
    return out


# ---------------------------------------------------------------- join


def nodes_of(sig: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, n, node), and one node for each distinct sequence of words with its signature."""
    some = sig.where("n > 0 and doc_id is not null")
    classes = spill(some.groupBy("fp1", "fp2").agg(F.min(F.struct("doc_id", "rid")).alias("first")), "classes")
    member = some.select("doc_id", "n", "fp1", "fp2").join(classes, ["fp1", "fp2"]).select("doc_id", "n", F.col("first.doc_id").alias("node"))
    member = spill(member, "members")
    nodes = sig.join(classes.select(F.col("first.rid").alias("_rid")), F.col("rid") == F.col("_rid"))
    nodes = spill(nodes.select(F.col("doc_id").alias("node"), "n", "prefix", "counts", "keys"), "nodes")
    drop(classes)
    return member, nodes


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id and n of all rows, members, links between nodes)."""
    wide = spill(signatures(docs, hot_buckets(docs)), "signatures")
    every = spill(wide.select("doc_id", "n"), "rows")
    member, nodes = nodes_of(wide)
    drop(wide)
    # one doc_id may have several nodes (rows that repeat it): they are one vertex from the start
    # runs of min-hash keys
    rows = nodes.select(F.explode("keys").alias("key"), "node", F.col("node").alias("comp"), "n", "counts")
    first = verified(docs, candidates(in_stars(rows)))
    label = components(first)
    # runs of prefix shingles on which components meet
    named = nodes.join(label.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").withColumn("comp", F.coalesce("component", "node"))
    named = spill(named.select("node", "comp", "n", "prefix", "counts"), "named")
    drop(nodes)
    postings = named.select("node", "comp", F.explode("prefix").alias("key"))
    met = spill(postings.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key"), "met")
    drop(label)
    rows = spill(postings.join(met, "key").join(named.select("node", "n", "counts"), "node").select("key", "node", "comp", "n", "counts"), "runs")
    drop(met, named)
    found = candidates(in_cells(rows))
    drop(rows)
    second = verified(docs, refined(docs, found))
    return every, member, first.union(second)


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    every, member, edges = links(docs)
    # rows that repeat a doc_id tie their sets together
    twice = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    label = components(edges.union(twice))
    by_doc = member.join(label, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component_id"))
    out = every.select("doc_id", F.col("n").alias("n_shingles")).join(by_doc.withColumnRenamed("doc_id", "_d"), F.col("doc_id") == F.col("_d"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, columns as they are: the row of the smallest doc_id, and of rows that repeat
    that doc_id the one of the smallest text.

    Rows that a bloom filter proves to stay aren't shuffled.  Rows without a
    doc_id, or without words, stay.
    """
    columns = docs.columns
    names = {c: f"_loom_d{k}" for k, c in enumerate(columns) if c not in ("doc_id", "text")}
    rows = docs.withColumnsRenamed(names)
    state = spill(join(docs.select("doc_id", "text")).where("doc_id is not null and n_shingles > 0"), "state")
    # of documents that go, and of rows that repeat a doc_id, which are told apart by number
    ask = spill(state.groupBy("doc_id").agg(F.count("*").alias("_times"), F.min("component_id").alias("_first")).where("doc_id <> _first or _times > 1").withColumnRenamed("doc_id", "_asked"), "gone")
    marked = maybe_in(rows, "doc_id", bloom(ask, "_asked"))
    some = marked.where("_maybe").join(ask, F.col("doc_id") == F.col("_asked"), "left")
    # words decide as they do in the join: a blank text stays
    empty = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    here = (F.col("_first") == F.col("doc_id")) & ~empty
    number = F.row_number().over(Window.partitionBy("doc_id", empty).orderBy(F.xxhash64("text"), "text"))
    once = some.where(F.col("_asked").isNull() | empty)
    rest = some.where(here & (F.col("_times") > 1)).withColumn("_number", number).where("_number = 1")
    out = [x.select(*[c for c in rows.columns]) for x in (marked.where("not _maybe"), once, rest)]
    return out[0].unionByName(out[1]).unionByName(out[2]).withColumnsRenamed({v: k for k, v in names.items()}).select(*columns)
