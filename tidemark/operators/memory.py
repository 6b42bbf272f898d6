"""Jobs on notes ("memories"): store, list, age out, update, fetch. Each takes and gives whole tables; a caller writes the
result to a fresh place (sources.snapshots), never over what it reads.

Times are `now` or columns; a note's row has the columns of plans.views.MEMORY_COLUMNS, at least those that a job names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.render import render_compact, render_full
from tidemark.functions.scalars import STALE_BELOW, STALE_DAYS, at_time, content_hash, days_since, has_all_tags, is_stale, retention_score, sanitize
from tidemark.operators.ranking import pack_budget, pending_captures
from tidemark.operators.vectors import Embedder, embed_text

DEDUP_WINDOW = 30
LIST_LIMIT, CEILING_TIMES, CEILING_LEAST = 20, 4, 200
CONTEXT_ROWS, CONTEXT_IMPORTANCE = 500, 0.4
EXACT = 9


def age_days(now) -> Column:
    """Since the last access, else since creation."""
    return days_since(F.coalesce("last_accessed", "created_at"), now)


def retention(now) -> Column:
    return F.round(retention_score("type", "importance", age_days(now), "access_count", "source"), EXACT)


# Fetching


def get_memories(ids: DataFrame, memories: DataFrame) -> DataFrame:
    """Each asked (project_id, id) with its ord, found or not, and the note's columns."""
    return ids.join(memories.withColumn("_found", F.lit(True)), ["project_id", "id"], "left").withColumn("found", F.col("_found").isNotNull()).drop("_found")


def get_vectors(ids: DataFrame, memories: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """(project_id, id, embedding) of asked notes, of the current model."""
    own = ids.select("project_id", "id").distinct().join(memories.select("project_id", "id"), ["project_id", "id"])
    return own.join(vectors.filter(F.col("embed_model") == model).select(F.col("memory_id").alias("id"), "embedding"), "id").select("project_id", "id", "embedding")


def missing_vectors(memories: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    have = vectors.filter(F.col("embed_model") == model).select(F.col("memory_id").alias("id"))
    return memories.filter("status = 'active'").join(have, "id", "left_anti")


# Storing


def prepare_memories(requests: DataFrame, now) -> DataFrame:
    """Requests as rows to store: redacted, hashed, with defaults. ord keeps the requests' order."""
    time = at_time(now)
    return requests.withColumns(
        {
            "title": sanitize("title"),
            "content": sanitize("content"),
            "importance": F.coalesce(F.col("importance").cast("double"), F.lit(0.5)),
            "facts": F.when(F.size("facts") > 0, F.col("facts")),
            "tags": F.when(F.size("tags") > 0, F.col("tags")),
            "given_source": F.col("source"),
            "given_pinned": F.col("pinned"),
            "source": F.coalesce("source", F.lit("realtime")),
            "pinned": F.coalesce("pinned", F.lit(False)),
            "created_at": time,
            "updated_at": time,
        }
    ).withColumn("content_hash", content_hash("content"))


def dedup_window(df: DataFrame, existing: DataFrame | None = None, window_secs: int = DEDUP_WINDOW, keys: tuple[str, ...] = ("content_hash", "session_id"), ts: str = "created_at", id_col: str = "id") -> DataFrame:
    """Adds kept and dup_of: in time order a row is kept if at least window_secs have passed since the last kept row of
    its keys; a dropped row doesn't move the window. Existing rows count as kept. Null keys are keys of their own.

    A key's (time, id) rows come to one task in order of time and are judged as they stream by, so memory is bounded for
    hot keys too. Rows without a time are kept and don't move the window.
    """
    key = lambda: F.to_json(F.struct(*keys)).alias("_key")
    rows = df.select(key(), F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), F.col(id_col).alias("_id"), F.lit(False).alias("_old"))
    if existing is not None:
        touched = existing.select(key(), F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), F.col(id_col), F.lit(True)).join(rows.select("_key").distinct(), "_key", "left_semi")
        rows = rows.union(touched)
    kind = df.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = last = owner = None
        for batch in batches:
            new, kept, dup = [], [], []
            for k, t, i, old in zip(*(batch.column(c).to_pylist() for c in ("_key", "_t", "_id", "_old")), strict=True):
                if k != of:
                    of, last, owner = k, None, None
                keep = old or t is None or last is None or t - last >= window_secs * 1_000_000
                if not old:
                    new.append(i)
                    kept.append(keep)
                    dup.append(None if keep else owner)
                if keep and t is not None:
                    last, owner = t, i
            of_id = batch.schema.field("_id").type
            yield pa.RecordBatch.from_arrays([pa.array(new, of_id), pa.array(kept, pa.bool_()), pa.array(dup, of_id)], names=[id_col, "kept", "dup_of"])

    ordered = rows.repartition("_key").sortWithinPartitions("_key", "_t", F.desc("_old"), "_id")
    return df.join(ordered.mapInArrow(judge, f"`{id_col}` {kind}, kept boolean, dup_of {kind}"), id_col)


def upsert_topics(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """The table after a batch (with ord): rows of a topic fold into one. The earliest, an existing one first, gives id,
    type, created_at, session_id, access_count, last_accessed and status; the latest gives content, title, tags, facts,
    importance, content_hash and updated_at; source and pinned change only where given. Rows without a topic are new.
    Adds upserted: an existing or earlier row was updated."""
    columns = existing.columns
    old = existing.withColumns({"ord": F.lit(-1).cast("long"), "given_source": F.col("source"), "given_pinned": F.col("pinned")})
    new = batch.withColumn("ord", F.col("ord").cast("long"))
    for c in columns:
        if c not in new.columns:
            default = {"status": F.lit("active"), "access_count": F.lit(0)}.get(c, F.lit(None))
            new = new.withColumn(c, default.cast(existing.schema[c].dataType))
    wide = [*columns, "ord", "given_source", "given_pinned"]
    touched = new.filter("topic_key is not null").select("project_id", "topic_key").distinct()
    same = old.filter("topic_key is not null").join(touched, ["project_id", "topic_key"], "left_semi")
    rest = old.join(touched.withColumn("_hit", F.lit(True)), ["project_id", "topic_key"], "left").filter("_hit is null").select(*columns, F.lit(False).alias("upserted"))
    plain = new.filter("topic_key is null").select(*columns, F.lit(False).alias("upserted"))
    first = ["id", "type", "created_at", "session_id", "access_count", "last_accessed", "status"]
    last = ["content", "title", "tags", "facts", "importance", "content_hash", "updated_at"]
    given = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    aggs = {c: F.min_by(c, "ord") for c in first if c in columns} | {c: F.max_by(c, "ord") for c in last if c in columns}
    aggs |= {"source": F.coalesce(given("given_source"), F.lit("realtime")), "pinned": F.coalesce(given("given_pinned"), F.lit(False))}
    folded = same.select(*wide).unionByName(new.filter("topic_key is not null").select(*wide)).groupBy("project_id", "topic_key").agg(*(a.alias(c) for c, a in aggs.items()), (F.count(F.lit(1)) > 1).alias("upserted"))
    return rest.unionByName(plain).unionByName(folded.select(*columns, "upserted"))


def store_memories(requests: DataFrame, memories: DataFrame, vectors: DataFrame, embedder: Embedder, now) -> dict[str, DataFrame]:
    """The tables after a batch of requests, and each request's resulting id. Duplicates are judged against the table as
    it was and earlier requests; an upsert of the same batch doesn't change that. `created_at` of a request, if there is
    one, is its time of arrival, else now."""
    arrived = F.col("created_at").cast("timestamp") if "created_at" in requests.columns else at_time(now)
    rows = prepare_memories(requests.withColumn("_arrived", arrived), now).withColumns({"created_at": F.col("_arrived"), "updated_at": F.col("_arrived")}).drop("_arrived")
    judged = dedup_window(rows, memories.select("id", "content_hash", "session_id", "created_at"))
    kept = judged.filter("kept").drop("kept", "dup_of")
    table = upsert_topics(memories, kept)
    owner = table.filter("topic_key is not null").select("project_id", "topic_key", F.col("id").alias("owner"), "upserted")
    asked = judged.join(owner, ["project_id", "topic_key"], "left").withColumn("_own", F.coalesce("owner", "id"))
    # A duplicate of a request that went to another note is that note.
    went = asked.filter("kept").select(F.col("id").alias("dup_of"), F.col("_own").alias("_went"))
    results = asked.join(went, "dup_of", "left").select("ord", F.when(~F.col("kept"), F.coalesce("_went", "dup_of")).otherwise(F.col("_own")).alias("id"), (F.col("kept") & F.coalesce("upserted", F.lit(False)) & (F.col("owner") != F.col("id"))).alias("upserted"))
    changed = table.join(went.select(F.col("_went").alias("id")).distinct(), "id", "left_semi")
    fresh = embed_text(changed.select("id", F.concat_ws(" ", "title", "content").alias("_text")), "_text", embedder).select(F.col("id").alias("memory_id"), "embed_model", "embedding")
    left = vectors.join(changed.select(F.col("id").alias("memory_id")), "memory_id", "left_anti")  # of any model: the text is another
    return {"memories": table.drop("upserted"), "vectors": left.unionByName(fresh), "results": results}


# Listing and ageing


def list_memories(memories: DataFrame, requests: DataFrame, now) -> DataFrame:
    """For each request (request_id, project_id, type?, min_importance, wanted_tags, limit): of its newest
    max(4 limit, 200) active notes the best kept by retention, then those with all tags, up to the limit."""
    asked = requests.select("request_id", "project_id", F.col("type").alias("want_type"), "min_importance", "wanted_tags", F.coalesce("limit", F.lit(LIST_LIMIT)).alias("limit"))
    rows = memories.filter("status = 'active'").join(asked, "project_id").filter("importance >= min_importance and (want_type is null or type = want_type)")
    newest = F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("created_at"), "id"))
    near = rows.withColumn("_n", newest).filter(F.col("_n") <= F.greatest(F.col("limit") * CEILING_TIMES, F.lit(CEILING_LEAST))).withColumn("score", retention(now))
    tagged = near.filter(has_all_tags("tags", "wanted_tags"))
    rank = F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("score"), F.desc("created_at"), "id")) - 1
    return tagged.withColumn("rank", rank).filter("rank < limit").drop("_n", "want_type", "min_importance", "wanted_tags", "limit")


def list_stale(memories: DataFrame, now) -> DataFrame:
    """Active, unpinned notes created a week ago or earlier whose retention is low, with their score."""
    old = F.col("created_at").cast("timestamp") <= at_time(now) - F.expr(f"interval {STALE_DAYS} days")
    return memories.filter(F.col("status") == "active").filter(~F.col("pinned") & old).withColumn("score", retention(now)).filter(F.col("score") < STALE_BELOW)


def evict_stale(memories: DataFrame, vectors: DataFrame, now) -> dict[str, DataFrame]:
    gone = list_stale(memories, now)
    return {
        "memories": memories.join(gone.select("id"), "id", "left_anti"),
        "vectors": vectors.join(gone.select(F.col("id").alias("memory_id")), "memory_id", "left_anti"),
        "counts": gone.groupBy("project_id").agg(F.count(F.lit(1)).alias("evicted")),
    }


# Updates of single notes


def _marked(memories: DataFrame, ids: DataFrame, *more: str) -> DataFrame:
    asked = ids.select("project_id", "id", *more).groupBy("project_id", "id").agg(*(F.max(c).alias(c) for c in more), F.lit(True).alias("_hit"))
    return memories.join(asked, ["project_id", "id"], "left")


def delete_memories(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids' notes are marked deleted."""
    return _marked(memories, ids).withColumn("status", F.when(F.col("_hit"), "deleted").otherwise(F.col("status"))).select(*memories.columns)


def delete_report(memories: DataFrame, ids: DataFrame) -> DataFrame:
    asked = ids.select("project_id", "id").distinct()
    found = asked.join(memories.select("project_id", "id", F.lit(1).alias("hit")), ["project_id", "id"], "left")
    return found.groupBy("project_id").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("total"))


def pin_memories(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """ids has a column pin; deleted notes keep what they have."""
    new = F.when(F.col("_hit") & (F.col("status") != "deleted"), F.col("pin")).otherwise(F.col("pinned"))
    return _marked(memories, ids, "pin").withColumn("pinned", new).select(*memories.columns)


def touch_memories(memories: DataFrame, ids: DataFrame, now) -> DataFrame:
    hit = F.coalesce("_hit", F.lit(False))
    time = at_time(now).cast(memories.schema["last_accessed"].dataType)
    return _marked(memories, ids).withColumns({"access_count": F.col("access_count") + hit.cast("int"), "last_accessed": F.when(hit, time).otherwise(F.col("last_accessed"))}).select(*memories.columns)


def reembed(memories: DataFrame, vectors: DataFrame, embedder: Embedder) -> DataFrame:
    """Vectors after all active notes without one of the embedder's model got it; their older ones go."""
    need = missing_vectors(memories, vectors, embedder.model_id)
    fresh = embed_text(need.select("id", F.concat_ws(" ", "title", "content").alias("_text")), "_text", embedder).select(F.col("id").alias("memory_id"), "embed_model", "embedding")
    return vectors.join(need.select(F.col("id").alias("memory_id")), "memory_id", "left_anti").unionByName(fresh)


# Captures and the session's context


def append_captures(captures: DataFrame, notes: DataFrame, now) -> DataFrame:
    """notes: id, project_id, summary, context?; the summary is the raw data too."""
    new = notes.select("id", "project_id", at_time(now).cast(captures.schema["captured_at"].dataType).alias("captured_at"), F.coalesce("context", F.lit("note")).alias("tool_name"), "summary", F.col("summary").alias("raw_data"), F.lit(None).cast(captures.schema["presented_at"].dataType).alias("presented_at"))
    return captures.select(*new.columns).unionByName(new)


def mark_presented(captures: DataFrame, projects: DataFrame, now) -> DataFrame:
    time = at_time(now).cast(captures.schema["presented_at"].dataType)
    hit = captures.join(projects.select("project_id").distinct().withColumn("_hit", F.lit(True)), "project_id", "left")
    return hit.withColumn("presented_at", F.when(F.col("_hit") & F.col("presented_at").isNull(), time).otherwise(F.col("presented_at"))).select(*captures.columns)


def session_context(memories: DataFrame, captures: DataFrame, now) -> dict[str, DataFrame]:
    """What each project's session begins with: pending captures, and its notes in order of retention, whole while the
    budget lasts and as one line after; with the tables after the notes were seen and the captures presented."""
    projects = memories.select("project_id").distinct()
    none = F.array().cast("array<string>")
    asked = projects.select(F.col("project_id").alias("request_id"), "project_id", F.lit(None).cast("string").alias("type"), F.lit(CONTEXT_IMPORTANCE).alias("min_importance"), none.alias("wanted_tags"), F.lit(CONTEXT_ROWS).alias("limit"))
    listed = list_memories(memories, asked, now).withColumn("length", F.octet_length("content"))
    packed = pack_budget(listed, ["project_id"], [F.asc("rank")], "length")
    days = age_days(now)
    line = render_compact(is_stale("pinned", "score", days), "type", "importance", "score", "id", "created_at", "length", "title")
    full = render_full("type", "importance", "title", "id", "created_at", "tags", "content", "facts")
    notes = packed.select("project_id", "rank", "id", "score", "included", F.when(F.col("included"), full).otherwise(line).alias("text"))
    pending = pending_captures(captures)
    return {
        "notes": notes,
        "captures": pending,
        "memories_after": touch_memories(memories, notes.filter("included").select("project_id", "id"), now),
        "captures_after": mark_presented(captures, pending.select("project_id"), now),
    }


# Status


def store_status(memories: DataFrame) -> DataFrame:
    """Active notes and the newest note of each project, and of all (project_id null)."""
    return memories.rollup("project_id").agg(F.count_if(F.col("status") == "active").alias("active"), F.max("created_at").alias("last_created"))
