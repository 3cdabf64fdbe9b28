"""Sharding by sampled splitters (operator 10, native).

Records are ordered by a hash of their text (so equal texts lie side by side)
and then of their id.  A size-weighted sample of keys gives quantile
boundaries of ``ranges`` key ranges; an exact pass sums each range; a range
above ``overfull`` times its share (a large group of equal texts) is
subdivided by splitters on the second key.  Consecutive ranges then fill the
shards up to equal bytes, and the place in a shard is the range's offset plus
the place in the range, so no task sees more than a range.

Law ``bytes``: sizes (UTF-8 bytes plus 1) are near equal; equal texts share a
shard unless a boundary falls in their group.  Ranges follow the input, one for
each ``range_bytes``, so no range grows with it; the driver sees ``oversample``
keys and a few sums for each range.  Rows that no key tells apart (the same id
and text, or null ids with equal texts) and that overfill a range are placed one
by one, by the running sum of their sizes.

Nulls: a null text has size 1 and crc32 0; null ids are hashed like a value.
Rows alike in everything take neighbouring places.  Ties of keys are ordered by
id.  An empty table gives an empty result.  Columns of docs named like results
are kept with the prefix ``document_``; other names don't matter.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import give_way, spill

RESULTS = ("size", "text_crc32", "shard", "slot")


def _between(key: str, bounds: list[int]) -> Column:
    """Number of bounds <= key: a binary search in an array literal, in place of a join."""
    if not bounds:
        return F.lit(0)
    return _search(key, f"array({_values(bounds)})", len(bounds))


def _values(bounds: list[int]) -> str:
    return ",".join(f"{b}L" if b > -(2**63) else "-9223372036854775807L" for b in bounds)


def _search(key: str, bounds: str, most: int) -> Column:
    """Binary search in an SQL array of at most ``most`` bounds."""
    top = 1 << (most.bit_length() - 1)
    steps = ",".join(str(top >> k) for k in range(top.bit_length()))
    return F.expr(f"aggregate(array({steps}), 0, (at, step) -> at + if(at + step <= size({bounds}) and `{key}` >= get({bounds}, at + step - 1), step, 0))")


def _quantiles(rows: list[int], n: int) -> list[int]:
    rows = sorted(rows)
    return sorted({rows[len(rows) * k // n] for k in range(1, n)}) if rows else []


def assign(docs: DataFrame, shards: int = 16, ranges: int | None = None, range_bytes: int = 1 << 28, oversample: int = 16, overfull: float = 2.0, seed: int = 0, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """docs' rows with size, text_crc32, shard and slot; ``keep`` names the columns that ride along (doc_id if unset)."""
    keep = [doc_id] if keep is None else keep
    narrow_only = keep == [doc_id]
    # columns get private names while the work's own are beside them
    names = {c: f"_loom_d{k}" for k, c in enumerate(dict.fromkeys([*keep, doc_id]))}
    own = [
        F.xxhash64(text).alias("_key"),
        F.xxhash64(doc_id, F.length(text)).alias("_key2"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "utf-8")).cast("long").alias("text_crc32"),
    ]
    keyed = docs.select(*[F.col(c).alias(n) for c, n in names.items()], *own)
    if narrow_only:
        keyed = narrow = spill(keyed, "keys")
    else:
        narrow = spill(docs.select(F.col(doc_id).alias(names[doc_id]), *own[:3]), "keys")
    total = narrow.agg(F.sum("size")).first()[0] or 0
    ranges = ranges or max(64 * shards, total // range_bytes)
    # rows that repeat others draw for themselves; the draw only chooses splitters
    draw = F.pmod(F.xxhash64("_key", "_key2", F.monotonically_increasing_id(), F.lit(seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    drawn = narrow.where(draw < F.col("size") * (oversample * ranges / max(total, 1))).select("_key", "_key2").collect()
    bounds = _quantiles([r[0] for r in drawn], ranges)
    spot = _between("_key", bounds)
    sums = {r[0]: r[1] for r in narrow.groupBy(spot.alias("r")).agg(F.sum("size")).collect()}
    share = total / ranges
    # overfull ranges are cut on the second key, by quantiles of the sample's own records of that range;
    # all cuts are one nested literal, so the plan doesn't grow with their number
    inner = {}
    for r in sorted(r for r, b in sums.items() if b > overfull * share):
        if mine := _quantiles([k2 for k1, k2 in drawn if bisect_right(bounds, k1) == r], max(2, round(sums[r] / share))):
            inner[r] = mine
    sub = F.lit(0)
    if inner:
        cuts = "array(" + ",".join(f"array({_values(c)})" for c in inner.values()) + ")"
        which = f"array_position(array({','.join(map(str, inner))}), `_range`)"
        sub = F.when(F.expr(f"{which} > 0"), _search("_key2", f"get({cuts}, cast({which} as int) - 1)", max(map(len, inner.values())))).otherwise(0)
    ranged = lambda d: d.withColumn("_range", spot).withColumn("_sub", sub)
    per = sorted(tuple(r) for r in ranged(narrow).groupBy("_range", "_sub").agg(F.sum("size"), F.count("*")).collect())
    order = Window.partitionBy("_range", "_sub").orderBy("_key", "_key2", names[doc_id])
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def one_by_one(d: DataFrame) -> DataFrame:
        middle = F.col("_before") + F.sum("size").over(upto) - F.col("size") / 2
        return d.withColumn("_at", F.least(F.lit(shards - 1), F.floor(middle * shards / total).cast("int")))

    # what is overfull still has rows that no key tells apart
    rest = {(r, s): [] for r, s, size, _ in per if size > 2 * overfull * share and shards > 1}
    sql = docs.sparkSession.sql
    before, starts = 0, {}
    for r, s, size, _ in per:
        starts[r, s] = before
        before += size
    if rest:
        some = sql("SELECT * FROM VALUES " + ",".join(f"({r},{s},{starts[r, s]}L)" for r, s in rest) + " AS t(_r, _s, _before)")
        placed = one_by_one(ranged(narrow).join(some, (F.col("_range") == F.col("_r")) & (F.col("_sub") == F.col("_s"))))
        for r, s, at, n in sorted(tuple(x) for x in placed.groupBy("_range", "_sub", "_at").count().collect()):
            rest[r, s].append((at, n))
    place, counts = [], [0] * shards  # (range, sub, shard, slot of its first row, first and last row of the range there)
    for r, s, size, n in per:
        parts = rest.get((r, s)) or [(min(shards - 1, int((starts[r, s] + size / 2) * shards / total)), n)]
        first = 0
        for shard, m in parts:
            place.append(f"({r},{s},{shard},{counts[shard] - first}L,{first}L,{first + m}L)")
            counts[shard] += m
            first += m
    # one row for each range, its parts and their shards
    table = sql(f"SELECT * FROM VALUES {','.join(place) or '(0,0,0,0L,0L,0L)'} AS t(_r, _s, shard, _from, _low, _high)")
    out = ranged(keyed).withColumn("_row", F.row_number().over(order) - 1)
    out = out.join(table, (F.col("_range") == F.col("_r")) & (F.col("_sub") == F.col("_s")) & (F.col("_row") >= F.col("_low")) & (F.col("_row") < F.col("_high")))
    docs_own = give_way(out.select(*[F.col(names[c]).alias(c) for c in keep]), RESULTS).columns
    return out.select(*[F.col(names[c]).alias(d) for c, d in zip(keep, docs_own, strict=True)], "size", "text_crc32", "shard", (F.col("_from") + F.col("_row")).alias("slot"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """One folder per shard, each in the order of slots."""
    keep = docs.columns
    assign(docs, keep=keep, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
