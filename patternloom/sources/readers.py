"""Readers: every source becomes a DataFrame; nothing is opened outside Spark's own readers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.extract import parse_posts
from ..schema import PARSED
from ..session import ship


PIECE = "file string, file_size long, start long, at long, size long, value string"


def pieces(spark: SparkSession, path: str, sep: str = "\n", **options) -> DataFrame:
    """(file, offset, value, closed): the text between separators with its byte offset in the file; the last piece of a
    file is closed if a separator ends it.

    Large files are split.  Spark gives no offsets, so each split's bytes are
    added up as they stream by, and a second pass over the input (a row for each
    split remains) gives where its first piece begins.
    """
    ship(spark)
    m = F.col("_metadata")
    rows = spark.read.option("recursiveFileLookup", True).options(**options).option("lineSep", sep).text(path)
    rows = rows.select(m["file_path"].alias("file"), m["file_size"].alias("file_size"), m["file_block_start"].alias("start"), F.octet_length("value").cast("long").alias("size"), "value")
    width = len(sep.encode())

    def run(batches):
        import numpy as np
        import pyarrow as pa

        file, start, upto = None, None, 0
        for batch in batches:
            files, starts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            size = batch.column(3).to_numpy() + width
            at = np.zeros(len(size), np.int64)
            first = [k for k in range(len(files)) if k == 0 or files[k] != files[k - 1] or starts[k] != starts[k - 1]]
            for k, end in zip(first, [*first[1:], len(files)], strict=True):
                if files[k] != file or starts[k] != start:
                    file, start, upto = files[k], starts[k], 0
                run_up = np.cumsum(size[k:end])
                at[k:end] = upto + run_up - size[k:end]
                upto += int(run_up[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(at), batch.column(3), batch.column(4)], names=["file", "file_size", "start", "at", "size", "value"])

    local = rows.mapInArrow(run, PIECE)
    splits = rows.groupBy("file", "start").agg(F.sum(F.col("size") + width).alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select(F.col("file").alias("_f"), F.col("start").alias("_s"), before.alias("_before"))
    # a row for each split: broadcast, so that the text isn't shuffled and a split isn't one task
    out = local.join(F.broadcast(splits), (F.col("file") == F.col("_f")) & (F.col("start") == F.col("_s"))).withColumn("offset", F.col("at") + F.col("_before"))
    return out.select("file", "offset", "value", (F.col("offset") + F.col("size") + width <= F.col("file_size")).alias("closed"))


def lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """(docid, content) of each line: two tab-separated columns are id and text; otherwise the id is the file's name and
    the line's byte offset, and the text is the whole line."""
    rows = pieces(spark, path, **options).withColumn("value", F.regexp_replace("value", "\r$", "")).withColumn("f", F.split("value", "\t"))
    two = F.size("f") == 2
    own = F.concat_ws(":", F.substring_index("file", "/", -1), F.col("offset").cast("string"))
    return rows.select(F.when(two, F.get("f", 0)).otherwise(own).alias("docid"), F.when(two, F.get("f", 1)).otherwise(F.col("value")).alias("content"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(docid, content): a document for each file, named by it; codecs as Spark reads them."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("docid"), F.col("value").alias("content"))


def elements(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """(content): the text from each start marker to the next end marker, both included.

    The end marker is the record separator, so large files are split; a last
    record without its end marker is no record.
    """
    rows = pieces(spark, path, end).where("closed")
    at = F.locate(start, F.col("value"))
    return rows.where(at > 0).select(F.concat(F.expr(f"substring(value, locate({_sql(start)}, value))"), F.lit(end)).alias("content"))


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def trec(spark: SparkSession, path: str) -> DataFrame:
    """(docid, content) of SGML documents: the id is the DOCNO element, else the DOC element's id; the markup stays."""
    rows = elements(spark, path, "<DOC", "</DOC>")
    number = F.trim(F.regexp_extract("content", r"(?s)<DOCNO>(.*?)</DOCNO>", 1))
    named = F.regexp_extract("content", r"""<DOC[^>]*\bid=["']([^"']*)["']""", 1)
    return rows.select(F.when(number != "", number).otherwise(named).alias("docid"), "content")


def posts(spark: SparkSession, path: str) -> DataFrame:
    """JSON posts, one in a line; see ``parse_posts``."""
    return parse_posts(spark.read.option("recursiveFileLookup", True).text(path))


WARC = "record_type string, date string, uuid string, content_type string, metadata map<string,string>, content binary, docid string, text string"


class _Stream:
    """Bytes of a file, decompressed as they are asked for (gzip members, bzip2, or plain)."""

    STEP = 1 << 20

    def __init__(self, raw):
        import bz2
        import zlib

        self.raw, self.at, self.held = memoryview(raw), 0, b""
        magic = bytes(self.raw[:3])
        self.make = (lambda: zlib.decompressobj(31)) if magic[:2] == b"\x1f\x8b" else bz2.BZ2Decompressor if magic == b"BZh" else None
        self.d = self.make() if self.make else None

    def more(self) -> bool:
        """Take another piece into ``held``; false at the end."""
        if self.at >= len(self.raw):
            return False
        piece = bytes(self.raw[self.at : self.at + self.STEP])
        self.at += len(piece)
        while piece and self.d:
            self.held += self.d.decompress(piece)
            piece = self.d.unused_data
            if self.d.eof:
                self.d = self.make()
        if not self.make:
            self.held += piece
        return True

    def find(self, what: bytes, start: int = 0) -> int:
        while (k := self.held.find(what, start)) < 0 and self.more():
            pass
        return k

    def skip(self, n: int) -> None:
        self.held = self.held[n:]

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out, self.held = self.held[:n], self.held[n:]
        return out


def parse_warc(raw) -> Iterator[dict]:
    """Records of a WARC file: from a version line through all headers, then Content-Length bytes; one is held at a time."""
    s, fresh = _Stream(raw), True
    while (at := s.find(b"WARC/")) >= 0:
        if at and s.held[at - 1 : at] != b"\n" or not at and not fresh:
            s.skip(at + 5)
            fresh = False
            continue
        s.skip(at)
        ends: list = []
        while not ends:
            ends = [(k, len(sep)) for sep in (b"\r\n\r\n", b"\n\n") if (k := s.held.find(sep)) >= 0]
            if not ends and not s.more():
                return
        end, gap = min(ends)
        head = {}
        for line in s.take(end).decode("utf-8", "replace").splitlines()[1:]:
            name, _, value = line.partition(":")
            head[name.strip()] = value.strip()
        s.skip(gap)
        body = s.take(int(head.get("Content-Length", "0") or 0))
        known = {k: head.pop(k, None) for k in ("WARC-Type", "WARC-Date", "WARC-Record-ID", "Content-Type")}
        yield {"record_type": known["WARC-Type"], "date": known["WARC-Date"], "uuid": known["WARC-Record-ID"], "content_type": known["Content-Type"], "metadata": list(head.items()), "content": body, "docid": head.get("WARC-TREC-ID"), "text": payload_text(body)}
        fresh = True


def payload_text(body: bytes) -> str:
    """What follows the first Content-Length line of the payload; all of it if there is none."""
    text = body.decode("utf-8", "replace")
    at = text.find("Content-Length:")
    if at < 0:
        return text
    end = text.find("\n", at)
    return text[end + 1 :] if end >= 0 else ""


def warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of (compressed) web archives; a file is one task's work, as gzip can't be split, and is decompressed
    record by record."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        kinds = {"metadata": pa.map_(pa.string(), pa.string()), "content": pa.binary()}
        names = [f.split()[0] for f in WARC.split(", ")]

        def rows(some):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in some], kinds.get(n, pa.string())) for n in names], names=names)

        for batch in batches:
            for raw in batch.column(1):
                some, size = [], 0
                for r in parse_warc(raw.as_buffer()):
                    some.append(r)
                    size += len(r["content"])
                    if size > 8 << 20 or len(some) == 500:
                        yield rows(some)
                        some, size = [], 0
                yield rows(some)

    return files.mapInArrow(run, WARC)


def parsed(spark: SparkSession, path: str) -> DataFrame:
    """Annotated documents held as Parquet."""
    return spark.read.schema(PARSED).parquet(path)


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """(id, context, pattern, weight) of tab-separated examples; a literal ``*`` stands for no value."""
    rows = spark.read.schema("id string, context string, pattern string, weight double").csv(path, sep="\t", quote="")
    return rows.select("id", *[F.when(F.col(c) != "*", F.col(c)).alias(c) for c in ("context", "pattern")], "weight")


def regex_list(spark: SparkSession, path: str) -> list[str]:
    """One regular expression in a line."""
    return [r.value for r in spark.read.text(path).where("value <> ''").collect()]


def relation_types(spark: SparkSession, path: str) -> DataFrame:
    """(rel_id, rel_name, args): id, name, then name, type and class of each argument, tab-separated; lines of any other
    shape raise."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    good = (F.size("f") >= 5) & ((F.size("f") - 2) % 3 == 0)
    f = f.withColumn("f", F.when(good, F.col("f")).otherwise(F.raise_error(F.lit("a relation type needs 2 + 3k columns"))))
    args = F.transform(F.sequence(F.lit(0), ((F.size("f") - 2) / 3).cast("int") - 1), lambda i: F.struct(F.get("f", 2 + 3 * i).alias("name"), F.get("f", 3 + 3 * i).alias("type"), F.get("f", 4 + 3 * i).alias("class")))
    return f.select(F.get("f", 0).alias("rel_id"), F.get("f", 1).alias("rel_name"), args.alias("args"))


def relation_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(name, pattern, weight): two or three tab-separated columns, weight 1 unless given."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    f = f.withColumn("f", F.when(F.size("f").between(2, 3), F.col("f")).otherwise(F.raise_error(F.lit("a relation pattern has 2 or 3 columns"))))
    return f.select(F.get("f", 0).alias("name"), F.get("f", 1).alias("pattern"), F.coalesce(F.get("f", 2).cast("double"), F.lit(1.0)).alias("weight"))
