"""The code index as bucketed tables: built once, then refreshed by files or by commits a few buckets at a time.

A path's bucket holds all that belongs to it: its manifest row, chunks, their vectors and links, the commits that these
name, and the file's history. So a refresh reads and writes the buckets of its paths only, and a batch of n files touches
at most n of them. Commits that files of several buckets share lie in each; reading folds them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.history import UPDATE_LIMIT, apply_history, file_history, link_chunks
from tidemark.operators.indexing import build_index, update_index
from tidemark.operators.steps import save
from tidemark.operators.vectors import Embedder
from tidemark.sources.bucketed import BUCKETS, bucket_count, bucket_of, publish, read_tables
from tidemark.sources.snapshots import remove


def packed(chunks: DataFrame) -> DataFrame:
    """Chunks without the texts that their previews hold: a name that stands in the preview is kept as its place there, a
    qualified name that is the name as a mark."""
    at, same = F.expr("instr(body_preview, symbol_name)"), F.coalesce(F.col("qualified_name") == F.col("symbol_name"), F.lit(False))
    place = F.when(at > 0, F.struct(at.alias("at"), F.char_length("symbol_name").alias("size")))
    return chunks.withColumns({"_named": place, "_same": same, "symbol_name": F.when(at > 0, None).otherwise(F.col("symbol_name")), "qualified_name": F.when(same, None).otherwise(F.col("qualified_name"))})


def unpacked(chunks: DataFrame) -> DataFrame:
    """The reverse; chunks that were stored whole stay as they are."""
    if "_named" not in chunks.columns:
        return chunks
    name = F.when(F.col("_named").isNotNull(), F.substring("body_preview", F.col("_named.at"), F.col("_named.size"))).otherwise(F.col("symbol_name"))
    return chunks.withColumns({"symbol_name": name, "qualified_name": F.when(F.col("_same"), name).otherwise(F.col("qualified_name"))}).drop("_named", "_same")


def dealt(index: dict[str, DataFrame], buckets: int) -> dict[str, DataFrame]:
    """The tables with their bucket, that of the path they belong to."""
    if "file_path" not in index["vectors"].columns:
        index = index | {"vectors": index["vectors"].join(index["chunks"].select(F.col("id").alias("chunk_id"), "file_path"), "chunk_id")}
    out = {"files": "path", "history": "path", "links": "path", "chunks": "file_path", "vectors": "file_path"}
    index = index | {"chunks": packed(index["chunks"])}
    tables = {name: index[name].withColumn("bucket", bucket_of(key, buckets)) for name, key in out.items()}
    named = tables["links"].select(F.col("commit_sha").alias("sha"), "bucket").distinct()
    return tables | {"commits": index["commits"].join(named, "sha")}


@contextmanager
def staging(spark: SparkSession, root: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Writes rows below root and reads them again, until all that is made of them is published."""
    home = f"{root}/staging-{uuid.uuid4().hex}"

    def held(df: DataFrame) -> DataFrame:
        path = f"{home}/{uuid.uuid4().hex}"
        save(df, path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield held
    finally:
        remove(spark, home)


def build(spark: SparkSession, root: str, files: DataFrame, changes: DataFrame, embedder: Embedder, now, buckets: int = BUCKETS) -> None:
    """A full build of the index at root."""
    with staging(spark, root) as held:
        create_index(spark, build_index(files, changes, embedder, now, held), root, buckets)


def create_index(spark: SparkSession, index: dict[str, DataFrame], root: str, buckets: int = BUCKETS) -> None:
    publish(spark, root, dealt(index, buckets), buckets)


def load_index(spark: SparkSession, root: str, touched: list[int] | None = None) -> dict[str, DataFrame]:
    """The tables of the newest whole version (of some buckets)."""
    index = {name: df.drop("bucket") for name, df in read_tables(spark, root, touched).items()}
    index["chunks"] = unpacked(index["chunks"])
    bridge = link_chunks(index["chunks"], index["links"].withColumnRenamed("commit_sha", "sha"))
    return index | {"bridge": bridge, "commits": index["commits"].dropDuplicates(["sha"])}


def touched_by(paths: DataFrame, buckets: int) -> list[int]:
    """At most as many numbers as there are buckets."""
    return sorted(r.bucket for r in paths.select(bucket_of("path", buckets).alias("bucket")).distinct().collect())


def refresh_files(spark: SparkSession, root: str, paths: DataFrame, read_files: Callable[[DataFrame], DataFrame], embedder: Embedder, now) -> list[int]:
    """The index after what happened to paths: read_files gives (path, text, content_hash) of those that still are; the
    others are dropped. Gives the buckets that were written."""
    buckets = bucket_count(spark, root)
    touched = touched_by(paths, buckets)
    if not touched:
        return []
    index = load_index(spark, root, touched)
    files = read_files(paths).select("path", "text", "content_hash")
    rest = index["files"].join(paths, "path", "left_anti").select("path", F.lit(None).cast("string").alias("text"), "content_hash")
    with staging(spark, root) as held:
        fresh = update_index(index, files.unionByName(rest), None, embedder, now, held=held)
        publish(spark, root, dealt(fresh, buckets), buckets, touched)
    return touched


def refresh_commits(spark: SparkSession, root: str, changes: DataFrame, now, limit: int = UPDATE_LIMIT) -> list[int]:
    """The index after a batch of commits: churn, hotspots, links and histories of its files; manifest and vectors stay
    where they are. Gives the buckets that were written."""
    buckets = bucket_count(spark, root)
    with staging(spark, root) as held:
        # The batch's histories are all that is needed of it; it is read once.
        batch = held(file_history(changes))
        touched = touched_by(batch, buckets)
        if not touched:
            return []
        fresh = dealt(apply_history(load_index(spark, root, touched), batch, now, limit), buckets)
        publish(spark, root, {name: fresh[name] for name in ("chunks", "links", "commits", "history")}, buckets, touched)
    return touched
