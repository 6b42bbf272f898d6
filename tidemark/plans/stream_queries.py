"""Queries that run the streaming jobs to the end of what the given tables hold, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import index_store, vectors
from tidemark.plans import job_queries as J
from tidemark.plans.scalar_queries import EXCLUDED_SQL, LANGUAGE_SQL, PATHS_SQL
from tidemark.plans.views import HISTORY_NOW, scratch, view
from tidemark.streaming import jobs


def streamed(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    # As a pattern, since a stream's own path must be a folder and a table may be one file.
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{table}.parquet").schema).parquet(f"{sf_dir}/{table}[.]parquet")


def to_the_end(stream: DataFrame) -> DataFrame:
    """All that a stream gives, as a table."""
    spark, home = stream.sparkSession, scratch(stream.sparkSession)
    stream.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


def t1_stream_dirty_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = streamed(spark, sf_dir, "documents").selectExpr(*[x for x in PATHS_SQL.removeprefix("SELECT doc_id, ").removesuffix(" FROM documents").split("\n")], "case when doc_id % 9 = 0 then 'rename' else 'modify' end as kind")
    return to_the_end(jobs.stream_dirty_paths(events)).distinct()


T1_SQL = f"SELECT DISTINCT path FROM ({PATHS_SQL}) WHERE doc_id % 9 <> 0 AND NOT ({EXCLUDED_SQL}) AND ({LANGUAGE_SQL}) IS NOT NULL"


def t1_incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of documents that came, changed or went reach the index as a stream of events, in several batches' files."""
    files, root = J.source_files(spark, sf_dir), scratch(spark)
    number = F.regexp_extract("path", r"/d(\d+)", 1).cast("long")
    before = files.filter(number % 7 != 5).withColumn("text", F.when(number % 7 == 2, F.lit("# old\n")).otherwise(F.col("text"))).withColumn("content_hash", F.sha2("text", 256))
    after = files.filter(number % 7 != 3)
    index_store.build(spark, root, before, J.document_changes(spark, sf_dir), vectors.HashedWords(), HISTORY_NOW)
    events = streamed(spark, sf_dir, "documents").filter("doc_id % 7 in (2, 3, 5)").select(J.document_path().alias("path"), F.lit("modify").alias("kind"))
    jobs.run_incremental_index(events, root, lambda paths: after.join(paths, "path", "left_semi"), vectors.HashedWords(), HISTORY_NOW, f"{root}/checkpoint", once=True).awaitTermination()
    return J.index_rows(index_store.load_index(spark, root))


def t2_commit_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the last days arrive as commits; the index knows those before."""
    root, changes = scratch(spark), view(spark, sf_dir, "changes_v")
    recent = "timestamp_ntz'2001-07-30 00:00:00'"
    with index_store.staging(spark, root) as held:
        index_store.create_index(spark, J.index_of(spark, sf_dir, changes.filter(f"ts < {recent}"), held), root)
    orders = streamed(spark, sf_dir, "orders").filter(f"o_orderdate >= {recent}").select(F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 40).alias("sha"))
    jobs.run_commit_updates(orders.join(changes.filter(f"ts >= {recent}"), "sha"), root, HISTORY_NOW, f"{root}/checkpoint", once=True).awaitTermination()
    return index_store.load_index(spark, root)["chunks"].select("id", "churn_count", "hotspot_score")


def t3_stream_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = streamed(spark, sf_dir, "events")
    none = F.lit(None)
    requests = events.select(
        F.col("event_id").cast("string").alias("id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.lit("p").alias("project_id"), F.lit("fact").alias("type"), F.lit("t").alias("title"), F.col("event_type").alias("content"),
        F.col("ts").cast("timestamp").alias("created_at"), none.cast("double").alias("importance"), none.cast("string").alias("source"), none.cast("boolean").alias("pinned"), none.cast("array<string>").alias("facts"), none.cast("array<string>").alias("tags"),
    )
    return to_the_end(jobs.stream_store(requests, 21600)).select("id", "kept", "dup_of")


def t4_stream_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = scratch(spark)
    notes = streamed(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.lit("p").alias("project_id"), F.lit("2024-01-01").cast("timestamp").alias("captured_at"), F.col("url").alias("summary"), F.when(F.col("page_id") % 2 == 0, "web").alias("context"))
    jobs.stream_captures(notes, f"{home}/out", f"{home}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{home}/out").select("id", "tool_name", "raw_data")


QUERIES = {"t1_stream_dirty_paths": t1_stream_dirty_paths, "t1_incremental_index": t1_incremental_index, "t2_commit_updates": t2_commit_updates, "t3_stream_store": t3_stream_store, "t4_stream_captures": t4_stream_captures}
SQL = {
    "t1_stream_dirty_paths": T1_SQL,
    "t1_incremental_index": J.SQL["c4_update_index"],
    "t2_commit_updates": J.SQL["c5_apply_commits"],
    "t3_stream_store": J.dedup_sql(21600),
    "t4_stream_captures": "SELECT CAST(page_id AS VARCHAR) AS id, CASE WHEN page_id % 2 = 0 THEN 'web' ELSE 'note' END AS tool_name, url AS raw_data FROM pages",
}
