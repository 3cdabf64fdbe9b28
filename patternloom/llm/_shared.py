"""What several operators share: the shared folder, bloom filters, components, labels."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one of our own on a local master (tests), else an error."""
    global _own
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="loom-")
    return _own


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a
    lost executor costs no recomputation beyond the running stage."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"loom-{uuid.uuid4().hex}-{name}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete spilled tables that nothing reads any more, and let Spark delete the shuffles behind them."""
    for t in tables:
        spark, path = t.sparkSession, t._loom_path
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package where Python workers find it."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def give_way(docs: DataFrame, results: tuple[str, ...]) -> DataFrame:
    """docs whose columns named like results have the prefix ``document_`` (again, while that name is taken too)."""
    names, taken = {}, {*docs.columns, *results}
    for c in docs.columns:
        if c in results:
            new = f"document_{c}"
            while new in taken:
                new = f"document_{new}"
            taken.add(new)
            names[c] = new
    return docs.withColumnsRenamed(names) if names else docs


#: bytes of text in a batch that a Python worker gets: long texts come few at a time
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---------------------------------------------------------------- labels


def labelled(docs: DataFrame, labels: DataFrame, target: str, trains: Column, limit: int, seed: int = 0, columns: tuple = ("doc_id", "text")) -> DataFrame:
    """One row of docs for each label, at most ``limit``, chosen by a seeded hash of doc_id.

    A doc_id labelled both ways, or null, is left out; of rows that repeat a
    doc_id the smallest counts.  The labels are at most ``limit`` narrow rows,
    so they are broadcast; documents without one are not shuffled.
    """
    picked = (
        labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & trains)
        .groupBy("doc_id")
        .agg(F.min(target).alias("label"), F.max(target).alias("other"))
        .where("label = other")
        .select(F.col("doc_id").alias("label_id"), F.col("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("label_id", F.lit(seed)), "label_id")
        .limit(limit)
    )
    rows = docs.select(*columns).join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))
    rest = [c for c in columns if c != "doc_id"]
    return rows.groupBy("doc_id", "label").agg(F.min(F.struct(*rest)).alias("_row")).select("doc_id", *[F.col(f"_row.`{c}`") for c in rest], "label")


# ---------------------------------------------------------------- bloom filters

BLOOM_BITS = 1 << 23  # one MB whatever the input: a fuller filter only lets more rows pass


def bloom(ids: DataFrame, key: str, bits: int = BLOOM_BITS) -> np.ndarray:
    """A bloom filter (4 hashes) of a column of longs as packed words; its size is fixed."""
    at = [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits)) for k in range(4)]
    words = (
        ids.where(F.col(key).isNotNull())
        .select(F.explode(F.array(*at)).alias("b"))
        .select(F.shiftright("b", 6).alias("w"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("m"))
        .groupBy("w")
        .agg(F.bit_or("m").alias("m"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy()] = words["m"].to_numpy()
    return out


PLACES = [f"_loom_k{i}" for i in range(4)]


def with_places(df: DataFrame, key: str) -> DataFrame:
    """df with the places of key in a bloom filter, and whether it is null."""
    return df.withColumns({n: F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOOM_BITS)) for i, n in enumerate(PLACES)}).withColumn("_loom_null", F.col(key).isNull())


def places_set(batch, bits: np.ndarray) -> np.ndarray:
    """Rows of an Arrow batch whose places are all set."""
    ok = ~batch.column("_loom_null").to_numpy(zero_copy_only=False)
    for n in PLACES:
        b = batch.column(n).to_numpy(zero_copy_only=False)
        ok &= (bits[b >> 6] >> (b & 63)) & 1 == 1
    return ok


def maybe_in(df: DataFrame, key: str, words: np.ndarray) -> DataFrame:
    """df with a column ``_maybe``: false where the filter proves that key isn't in it. Null keys are never in it."""
    shared = df.sparkSession.sparkContext.broadcast(words)
    columns = df.columns
    wide = with_places(df, key)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", _maybe boolean"

    def mark(batches):
        import pyarrow as pa

        bits = shared.value
        for batch in batches:
            ok = places_set(batch, bits)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(ok)], names=[*columns, "_maybe"])

    return map_batches(wide, mark, schema)


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (u, v): the smallest node reachable.

    Each round every node takes the smallest label around it and then that
    label's own label (pointer jumping), so the number of rounds grows with
    the logarithm of the diameter; rounds go on until nothing changes.  Labels
    stay in the shared folder, those of the round before are deleted; the
    driver sees only whether something changed.
    """
    both = spill(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    held = spill(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")), "labels")
    labels = held
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("v"), "component"), "v")
            .groupBy("u")
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(near, labels.node == near.u, "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("component").alias("up"))
        step = step.join(up, "next", "left").select("node", "component", F.least("next", F.coalesce("up", "next")).alias("next"))
        step = spill(step, "labels")
        changed = step.where("component <> next").limit(1).count()
        labels = step.select("node", F.col("next").alias("component"))
        if not changed:
            drop(held, both)
            labels._loom_path = step._loom_path
            return labels
        drop(held)
        held = step
