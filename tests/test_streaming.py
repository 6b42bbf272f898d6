"""Streams over files, run until what is there is done, end as the batch jobs do."""

from pyspark.sql import functions as F

from tidemark.operators import history, index_store, indexing, memory, vectors
from tidemark.streaming import jobs

from .test_jobs import MD, PY, RS, changes, files, ids

NOW = "2024-01-01 00:00:00"


def save(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_store_stream_judges_as_the_batch(spark, tmp_path):
    rows = [(f"r{i:02}", "same" if i % 3 else "other", "s" if i % 2 else None, i * 7) for i in range(40)]
    req = spark.createDataFrame(rows, "id string, content string, session_id string, s long").selectExpr("id", "content", "session_id", "timestamp_seconds(1704067200 + s) as created_at", "'p' as project_id", "'fact' as type", "'T' as title", "cast(null as string) as topic_key", "cast(null as double) as importance", "cast(null as string) as source", "cast(null as boolean) as pinned", "cast(array() as array<string>) as facts", "cast(array() as array<string>) as tags")
    for part in (req.filter("id < 'r20'"), req.filter("id >= 'r20'")):
        save(part, f"{tmp_path}/in")
    stream = spark.readStream.schema(req.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = jobs.stream_store(stream, 30).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.id: (r.kept, r.dup_of) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = memory.dedup_window(memory.prepare_memories(req.withColumn("at", F.col("created_at")), NOW).withColumn("created_at", F.col("at")), window_secs=30)
    assert got == {r.id: (r.kept, r.dup_of) for r in batch.collect()} and len(got) == 40


def test_captures_are_appended(spark, tmp_path):
    notes = spark.createDataFrame([("a", "p", "x", None), ("b", "p", "y", "tool")], "id string, project_id string, summary string, context string").withColumn("captured_at", F.lit(NOW).cast("timestamp"))
    save(notes, f"{tmp_path}/in")
    jobs.stream_captures(spark.readStream.schema(notes.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", once=True).awaitTermination()
    assert {(r.id, r.tool_name, r.raw_data) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("a", "note", "x"), ("b", "tool", "y")}


def test_index_follows_files_and_commits(spark, tmp_path):
    embedder, root = vectors.HashedWords(8), f"file://{tmp_path}/index"
    log = changes(spark, ("s1", "a change worth a note", "a.py"))
    before, after = files(spark, a_py=PY, b_rs=RS, c_md=MD), files(spark, a_py=PY + "\n\ndef g():\n    pass\n", b_rs=RS, d_md=MD)
    index_store.create_index(spark, indexing.build_index(before, log, embedder, NOW), root)
    events = spark.createDataFrame([("a.py", "modify"), ("a.py", "modify"), ("c.md", "remove"), ("d.md", "create"), ("target/x.py", "create"), ("x.bin", "create")], "path string, kind string")
    save(events, f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    jobs.run_incremental_index(stream, root, lambda paths: after.join(paths, "path", "left_semi"), embedder, NOW, f"{tmp_path}/cp1", once=True).awaitTermination()
    got, want = index_store.load_index(spark, root), indexing.build_index(after, log, embedder, NOW)
    assert ids(got["chunks"]) == ids(want["chunks"]) and ids(got["files"], "path") == ["a.py", "b.rs", "d.md"] and ids(got["vectors"], "chunk_id") == ids(want["vectors"], "chunk_id")
    more = changes(spark, ("s2", "another good change", "b.rs"))
    save(more, f"{tmp_path}/commits")
    every = log.union(more)
    jobs.run_commit_updates(spark.readStream.schema(more.schema).parquet(f"{tmp_path}/commits"), root, NOW, f"{tmp_path}/cp2", once=True).awaitTermination()
    churn = {r.file_path: r.churn_count for r in index_store.load_index(spark, root)["chunks"].collect()}
    assert churn == {"a.py": 1, "b.rs": 1, "d.md": 0} and history.file_hotspots(history.commit_file_stats(every), NOW).count() == 2
