"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the filter that keeps rows which surely have no partner out of a second pass. Its size is fixed (1 MB).
FILTER_BITS = 1 << 23
BITS_PER_BUCKET = 8 * 4096  # what bitmap_construct_agg makes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tidemark-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where that is unset, a folder of our own on a local
    master, as in tests; elsewhere an error, since executors don't see the driver's folders."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
    return (named or own_dir()).rstrip("/")


#: Shuffle files of a job whose result is written are of no more use; Spark removes them at its end where this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows in a batch on its way to a Python worker. A batch of texts lies several times in the memory of both sides.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def save(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = {CLEANUP: spark.conf.get(CLEANUP, "false"), BATCH: spark.conf.get(BATCH)}
    rows = int(before[BATCH])
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: it cuts the lineage and outlives executors."""
    return save(df, f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}")


class Scratch:
    """The tables that a run of an operator writes to the shared folder on its way. A table may be dropped when all that
    was made from it is written; at the end only the result's is left. Use it in a with statement."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root, self.paths, self.number = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}", {}, count()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.remove(self.root)

    def remove(self, path: str) -> None:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{next(self.number)}"
        out = save(df, path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if id(df) in self.paths:
                self.remove(self.paths.pop(id(df))[0])

    def finish(self, df: DataFrame) -> DataFrame:
        """The result, written beside the run's folder."""
        return save(df, f"{self.root}-result")


def one_row_each(s: Scratch, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows of one id fold into the least by text and then by the other columns (which can be ordered, so aren't maps).
    Only rows of ids that may be repeated are shuffled. Rows without an id stay."""
    again = s.write(docs.select(F.col(id_column).alias("id")).filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "repeated")
    if not again.limit(1).count():
        return docs
    bits, flag, columns = id_filter(again, "id"), unused("bit", docs), docs.columns
    marked = docs.withColumn(flag, filter_bit(id_column))
    side = lambda inside: marked.mapInArrow(lambda batches: hits_only(batches, bits, flag, inside), marked.schema).select(*columns)
    maybe = s.write(side(True), "maybe-repeated")
    rest = [c for c in columns if c not in (id_column, text_column)]
    least = maybe.filter(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.min(F.struct(text_column, *rest)).alias("_row")).select(id_column, "_row.*").select(*columns)
    return side(False).unionByName(s.write(least, "folded")).unionByName(maybe.filter(F.col(id_column).isNull()))


def unused(name: str, *frames: DataFrame) -> str:
    """The name, with underscores after it until no frame has such a column."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filter_bit(c: str):
    return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))


def id_filter(ids: DataFrame, column: str, bit: Column | None = None) -> bytes:
    """A bitmap of FILTER_BITS bits with the bit of every id set (its filter_bit, or another given). Beyond some
    millions of ids it lets more rows through, never fewer."""
    bit = filter_bit(column) if bit is None else bit
    rows = (
        ids.select((bit / BITS_PER_BUCKET).cast("long").alias("k"), F.pmod(bit, F.lit(BITS_PER_BUCKET)).alias("p"))
        .groupBy("k")
        .agg(F.expr("bitmap_construct_agg(p)").alias("bits"))
        .collect()
    )
    size = BITS_PER_BUCKET // 8
    out = bytearray(FILTER_BITS // 8)
    for row in rows:
        out[row.k * size : (row.k + 1) * size] = bytes(row.bits).ljust(size, b"\0")
    return bytes(out)


def without_ids(docs: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """Docs whose id is not among ids (a column of the same name); only those that the ids' filter hits are shuffled."""
    bits, flag, columns = id_filter(ids, id_column), unused("bit", docs), docs.columns
    marked = docs.withColumn(flag, filter_bit(id_column))
    side = lambda inside: marked.mapInArrow(lambda batches: hits_only(batches, bits, flag, inside), marked.schema).select(*columns)
    return side(False).unionByName(side(True).join(ids, id_column, "left_anti").select(*columns))


def in_filter(bits: bytes, positions: np.ndarray) -> np.ndarray:
    table_ = np.frombuffer(bits, np.uint8)
    return (table_[positions >> 3] >> (positions & 7).astype(np.uint8)) & 1 == 1


def hits_only(batches: Iterator[pa.RecordBatch], bits: bytes, column: str = "bit", inside: bool = True) -> Iterator[pa.RecordBatch]:
    """The rows whose bit is in a filter, or those whose bit is not."""
    for batch in batches:
        yield batch.filter(pa.array(in_filter(bits, batch.column(column).to_numpy(zero_copy_only=False)) == inside))


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts Arrow batches into runs of rows with about `most` bytes of text (a longer text stands alone), and gives
    each with its UTF-8 bytes and row offsets. Null texts come as empty ones."""
    for batch in batches:
        texts = batch.column(column)
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            continue
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            stop = min(stop, len(texts))
            yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
            start = stop


def components(edges: DataFrame, s: Scratch) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component), the component's smallest node, for
    every node that has an edge. Labels of neighbours and of labels are taken in turn, so chains shrink by halves;
    each round is written to the shared folder."""
    ways = edges.filter("a is not null and b is not null and a <> b").select("a", "b")
    both = s.write(ways.union(ways.select("b", "a")).distinct(), "edges")
    table_ = s.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        labels = table_.select("node", "component")
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("via_component"))
        new = s.write(step.join(jump, "via").select("node", "was", F.least("via", "via_component").alias("component")), "labels")
        s.drop(table_)
        table_ = new
        if not new.filter("was <> component").limit(1).count():
            s.drop(both)
            return new.select("node", "component")


def merged_components(labels: DataFrame, more: DataFrame, s: Scratch) -> DataFrame:
    """Components after further edges (a, b): only the components that these join are looked at again."""
    ends = more.select("a").union(more.select("b")).distinct().withColumnRenamed("a", "node")
    every = s.write(labels.union(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))), "labels")
    near = more.join(every.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(every.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
    joined = components(near.select(F.col("ca").alias("a"), F.col("cb").alias("b")), s).select(F.col("node").alias("component"), F.col("component").alias("new"))
    out = s.write(every.join(joined, "component", "left").select("node", F.coalesce("new", "component").alias("component")), "labels")
    s.drop(every)
    return out
