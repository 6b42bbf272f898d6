"""Queries that run the library's jobs over the given tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import content_hash
from tidemark.operators import history, indexing, lexical, memory, ranking, retrieval, vectors
from tidemark.operators.steps import step
from tidemark.plans.scalar_queries import AGE_SQL, BODY_HASH_SQL, BOOST_SQL, COSINE_SQL, RETENTION_SQL, SIGNIFICANT_SQL, commit_weight_sql, low, sanitize_sql
from tidemark.plans.symbol_samples import SAMPLES, found_sql
from tidemark.plans.views import HISTORY_NOW, MODEL, NOW, scratch, view, with_views
from tidemark.sources import git_log, requests, snapshots, trees

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# Sources

LOG_SQL = "SELECT doc_id % 7 AS repo, doc_id AS pos, CASE doc_id % 5 WHEN 0 THEN substring(sha256(CAST(doc_id AS VARCHAR)), 1, 40) || '|' || CASE WHEN doc_id % 25 = 0 THEN 'x' ELSE CAST(1700000000 + doc_id AS VARCHAR) END || '|fix a|b ' || lang WHEN 3 THEN '-' || chr(9) || '7' || chr(9) || 'img/' || lang || '.png' WHEN 4 THEN 'noise' ELSE CAST(n_chars AS VARCHAR) || chr(9) || CAST(doc_id % 9 AS VARCHAR) || chr(9) || 'src/' || lang || '.rs' END AS line FROM (SELECT doc_id // 7 * 7 + doc_id % 7 AS doc_id, lang, n_chars FROM documents)"


@query("s2_parse_git_log", f"""
WITH l AS ({LOG_SQL}), h AS (SELECT *, regexp_matches(line, '^[0-9a-fA-F]{{40}}\\|[^|]*\\|') AS is_head FROM l),
g AS (SELECT *, sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER (PARTITION BY repo ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c FROM h),
heads AS (SELECT repo, c, split_part(line, '|', 1) AS sha, coalesce(TRY_CAST(split_part(line, '|', 2) AS BIGINT), 0) AS secs, regexp_extract(line, '^[^|]*\\|[^|]*\\|(.*)$', 1) AS message FROM g WHERE is_head)
SELECT CAST(g.repo AS VARCHAR) AS repo, sha, secs, message, split_part(line, chr(9), 3) AS path, coalesce(TRY_CAST(split_part(line, chr(9), 1) AS BIGINT), 0) AS added, coalesce(TRY_CAST(split_part(line, chr(9), 2) AS BIGINT), 0) AS deleted
FROM g JOIN heads ON g.repo = heads.repo AND g.c = heads.c WHERE NOT is_head AND len(string_split(line, chr(9))) = 3""")
def s2(s, d):
    doc = s.read.parquet(f"{d}/documents.parquet")
    tab, text = F.lit("\t"), lambda c: F.col(c).cast("string")
    ts = F.when(F.col("doc_id") % 25 == 0, "x").otherwise((F.lit(1700000000) + F.col("doc_id")).cast("string"))
    line = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.substring(F.sha2(text("doc_id"), 256), 1, 40), F.lit("|"), ts, F.lit("|fix a|b "), F.col("lang")))
        .when(F.col("doc_id") % 5 == 3, F.concat(F.lit("-"), tab, F.lit("7"), tab, F.lit("img/"), F.col("lang"), F.lit(".png")))
        .when(F.col("doc_id") % 5 == 4, "noise")
        .otherwise(F.concat(text("n_chars"), tab, (F.col("doc_id") % 9).cast("string"), tab, F.lit("src/"), F.col("lang"), F.lit(".rs")))
    )
    lines = doc.select((F.col("doc_id") % 7).cast("string").alias("repo"), F.col("doc_id").alias("pos"), line.alias("line"))
    return git_log.parse_git_log(lines).withColumn("secs", F.unix_seconds("ts")).drop("ts")


@query("s3_read_store_requests", "SELECT doc_id AS ord, 'p' AS project_id, 'fact' AS type, CASE WHEN doc_id % 3 = 0 THEN 0.25 ELSE CAST(doc_id % 10 AS DOUBLE) END AS importance, CASE WHEN doc_id % 2 = 0 THEN doc_id % 4 = 0 END AS pinned, CASE WHEN doc_id % 5 = 0 THEN [] ELSE [lang, source] END AS tags, lang AS title FROM documents")
def s3(s, d):
    doc = s.read.parquet(f"{d}/documents.parquet")
    text = lambda c: F.col(c).cast("string")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    tags = F.concat(F.lit("["), q(F.col("lang")), F.lit(","), q(F.col("source")), F.lit("]"))
    tags = F.when(F.col("doc_id") % 5 == 1, q(F.replace(tags, F.lit('"'), F.lit('\\"')))).otherwise(tags)
    imp = F.when(F.col("doc_id") % 3 == 0, '"0.25"').otherwise((F.col("doc_id") % 10).cast("string"))
    pin = F.when(F.col("doc_id") % 4 == 0, "true").otherwise('"false"')
    line = F.concat(F.lit('{"type":"fact","title":'), q(F.col("lang")), F.lit(',"importance":'), imp, F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(',"pinned":'), pin)).otherwise(""), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit(',"tags":'), tags)).otherwise(""), F.lit("}"))
    rows = requests.parse_store_requests(doc.select(F.col("doc_id").alias("ord"), line.alias("value")), "p")
    return rows.select("ord", "project_id", "type", "importance", "pinned", "tags", "title")


@query("s5_seed_copy", with_views("memories_v memory_vectors_v captures_v", """
SELECT 'memories' AS "table", count(*) FILTER (WHERE CAST(substring(id, 2) AS BIGINT) % 2 = 1) AS copied, count(*) AS after FROM memories_v
UNION ALL SELECT 'captures', count(*) FILTER (WHERE CAST(substring(id, 2) AS BIGINT) % 2 = 1), count(*) FROM captures_v
UNION ALL SELECT 'vectors', count(*), count(*) FROM memory_vectors_v"""))
def s5(s, d):
    odd = lambda df, c: df.filter(F.substring(c, 2, 20).cast("long") % 2 == 0)
    src = {"memories": view(s, d, "memories_v"), "captures": view(s, d, "captures_v"), "vectors": view(s, d, "memory_vectors_v")}
    out = snapshots.seed_copy(src, {"memories": odd(src["memories"], "id"), "captures": odd(src["captures"], "id"), "vectors": odd(src["vectors"], "memory_id")}, force=True)
    after = [out[t].agg(F.lit(t).alias("table"), F.count(F.lit(1)).alias("after")) for t in src]
    return out["counts"].join(after[0].union(after[1]).union(after[2]), "table")


@query("s6_upgrade_vectors", "SELECT 'm' || CAST(vec_id AS VARCHAR) AS memory_id, CASE WHEN vec_id % 3 = 1 THEN 'old' ELSE 'cur-model' END AS embed_model FROM embeddings")
def s6(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet")
    old = e.select(F.concat(F.lit("m"), F.col("vec_id").cast("string")).alias("memory_id"), F.when(F.col("vec_id") % 3 == 0, "").when(F.col("vec_id") % 3 == 1, "old").alias("embed_model"))
    return snapshots.upgrade_vectors(old, MODEL)


# Joins


@query("j1_get_memories", with_views("memories_v ids_v", "SELECT i.ord, i.id, i.project_id, m.id IS NOT NULL AS found, m.title, m.status FROM ids_v i LEFT JOIN memories_v m ON i.id = m.id AND i.project_id = m.project_id"))
def j1(s, d):
    return memory.get_memories(view(s, d, "ids_v").select("ord", "id", "project_id"), view(s, d, "memories_v")).select("ord", "id", "project_id", "found", "title", "status")


@query("j2_get_vectors", with_views("memories_v memory_vectors_v ids_v", f"SELECT DISTINCT m.project_id, m.id, round(v.embedding[1]::DOUBLE, 6) AS head FROM ids_v i JOIN memories_v m ON i.id = m.id AND i.project_id = m.project_id JOIN memory_vectors_v v ON v.memory_id = m.id AND v.embed_model = '{MODEL}'"))
def j2(s, d):
    return memory.get_vectors(view(s, d, "ids_v"), view(s, d, "memories_v"), view(s, d, "memory_vectors_v"), MODEL).select("project_id", "id", F.round(F.col("embedding")[0].cast("double"), 6).alias("head"))


@query("j3_missing_vectors", with_views("memories_v memory_vectors_v", f"SELECT id, project_id FROM memories_v WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM memory_vectors_v v WHERE v.memory_id = id AND v.embed_model = '{MODEL}')"))
def j3(s, d):
    return memory.missing_vectors(view(s, d, "memories_v"), view(s, d, "memory_vectors_v"), MODEL).select("id", "project_id")


@query("j4_diff_manifest", "WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 2) SELECT CAST(coalesce(a.doc_id, b.doc_id) AS VARCHAR) AS path, CASE WHEN b.doc_id IS NULL THEN 'new' WHEN a.doc_id IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def j4(s, d):
    doc = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("doc_id").cast("string").alias("path"), content_hash("text").alias("content_hash"))
    old = doc.filter("doc_id % 10 <> 2").withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("content_hash")))
    return indexing.diff_manifest(doc.filter("doc_id % 10 <> 1"), old)


RECENT_SQL = f"""
f AS (SELECT sha, path, CAST(sum(added + deleted) AS BIGINT) AS lines, min(ts) AS ts, min(message) AS message FROM changes_v GROUP BY sha, path),
near AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, sha) AS r FROM f),
recent AS (SELECT * FROM (SELECT sha, path, lines, ts, message, row_number() OVER (PARTITION BY path ORDER BY ts DESC, sha) - 1 AS rank FROM near WHERE r <= 30 AND {SIGNIFICANT_SQL}) WHERE rank < 10)"""
BRIDGE_SQL = "bridge AS (SELECT DISTINCT c.id AS chunk_id, r.sha AS commit_sha FROM chunks_v c JOIN recent r ON c.file_path = r.path)"


def recent_files(s, d):
    return ranking.recent_commits(history.commit_file_stats(view(s, d, "changes_v")))


@query("j5_related_commits", with_views("changes_v chunks_v", "SELECT c.id, coalesce(list(r.message ORDER BY b.commit_sha) FILTER (WHERE r.message IS NOT NULL), []) AS related_commits FROM chunks_v c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY commit_sha) AS n FROM bridge) b ON b.chunk_id = c.id AND n <= 3 LEFT JOIN (SELECT DISTINCT sha, message FROM f) r ON r.sha = b.commit_sha GROUP BY c.id", RECENT_SQL, BRIDGE_SQL))
def j5(s, d):
    chunks, recent = view(s, d, "chunks_v"), recent_files(s, d)
    return history.related_commits(chunks, history.link_chunks(chunks, recent), recent.select("sha", "message").distinct(), 3)


@query("j6_link_chunks", with_views("changes_v chunks_v", "SELECT * FROM bridge", RECENT_SQL, BRIDGE_SQL))
def j6(s, d):
    return history.link_chunks(view(s, d, "chunks_v"), recent_files(s, d)).drop("file_path")


@query("j7_symbol_history", with_views("hunks_v chunks_v", """SELECT id, rank, text FROM (SELECT id, substring(sha, 1, 7) || ' ' || message || ' (' || author || ', ' || strftime(ts, '%Y-%m-%d') || ')' AS text, row_number() OVER (PARTITION BY id ORDER BY ts DESC, sha, message, author) - 1 AS rank FROM (SELECT DISTINCT c.id, h.sha, h.ts, h.author, h.message FROM chunks_v c JOIN hunks_v h ON h.path = c.file_path AND h.start <= c.line_end AND h."end" >= c.line_start)) WHERE rank < 8"""))
def j7(s, d):
    return history.symbol_history(view(s, d, "chunks_v"), view(s, d, "hunks_v"))


# Aggregations


@query("a1_commit_file_stats", with_views("changes_v", "SELECT sha, path, lines FROM f", RECENT_SQL))
def a1(s, d):
    return history.commit_file_stats(view(s, d, "changes_v")).select("sha", "path", "lines")


HOTSPOT_SQL = f"hot AS (SELECT path, count(*) AS churn_count, round(sum({commit_weight_sql(HISTORY_NOW)}), 9) AS hotspot_score FROM recent GROUP BY path)"


@query("a2_file_hotspots", with_views("changes_v", "SELECT * FROM hot", RECENT_SQL, HOTSPOT_SQL))
def a2(s, d):
    return history.file_hotspots(history.commit_file_stats(view(s, d, "changes_v")), HISTORY_NOW)


@query("a3_store_status", with_views("memories_v", "SELECT project_id, count(*) FILTER (WHERE status = 'active') AS active, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_created FROM memories_v GROUP BY ROLLUP (project_id)"))
def a3(s, d):
    return memory.store_status(view(s, d, "memories_v")).withColumn("last_created", F.date_format("last_created", "yyyy-MM-dd HH:mm:ss"))


@query("a4_index_stats", with_views("chunks_v", "SELECT repo, count(DISTINCT file_path) AS files, count(*) AS chunks FROM (SELECT 'r' || CAST(length(id) AS VARCHAR) AS repo, file_path FROM chunks_v) GROUP BY repo UNION ALL SELECT NULL, (SELECT count(*) FROM (SELECT DISTINCT length(id), file_path FROM chunks_v)), (SELECT count(*) FROM chunks_v)"))
def a4(s, d):
    chunks = view(s, d, "chunks_v").select(F.concat(F.lit("r"), F.length("id").cast("string")).alias("repo"), "file_path")
    return history.index_stats(chunks.distinct(), chunks)


@query("a5_index_run_report", with_views("chunks_v", "SELECT count(DISTINCT file_path) AS files_scanned, count(DISTINCT file_path) FILTER (WHERE body_preview IS NOT NULL) AS files_indexed, count(*) FILTER (WHERE body_preview IS NOT NULL) AS chunks_stored FROM chunks_v"))
def a5(s, d):
    chunks = view(s, d, "chunks_v")
    return history.index_run_report(chunks.select(F.col("file_path").alias("path"), F.lit("new").alias("change")).distinct(), chunks.filter("body_preview is not null"))


# Windows and sets


@query("w1_top_k", "SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) - 1 AS rank FROM lineitem) WHERE rank < 5")
def w1(s, d):
    return ranking.top_k(s.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 5).drop("l_extendedprice").withColumn("rank", F.col("rank").cast("long"))


@query("w2_collapse_duplicates", with_views("chunks_v", f"SELECT id, symbol_kind, duplicate_count FROM (SELECT id, symbol_kind, row_number() OVER (PARTITION BY symbol_kind, h ORDER BY hotspot_score DESC, id) AS n, count(*) OVER (PARTITION BY symbol_kind, h) - 1 AS duplicate_count FROM (SELECT *, {BODY_HASH_SQL} AS h FROM chunks_v)) WHERE n = 1"))
def w2(s, d):
    from tidemark.functions.scalars import body_hash

    rows = view(s, d, "chunks_v").withColumn("h", body_hash("body_preview"))
    return ranking.collapse_duplicates(rows, ["symbol_kind"], "h", [F.desc("hotspot_score"), F.asc("id")]).select("id", "symbol_kind", "duplicate_count")


@query("w3_pack_budget", with_views("memories_v", "SELECT id, project_id, coalesce(sum(strlen(content)) OVER (PARTITION BY project_id ORDER BY created_at DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 30000 AS included FROM memories_v"))
def w3(s, d):
    rows = view(s, d, "memories_v").select("id", "project_id", "created_at", F.octet_length("content").alias("n"))
    return ranking.pack_budget(rows, ["project_id"], [F.desc("created_at"), F.asc("id")], "n").select("id", "project_id", "included")


@query("w4_apply_gates", "SELECT doc_id, source, score FROM (SELECT *, max(score) OVER (PARTITION BY source, m) AS top FROM (SELECT doc_id, source, doc_id % 7 AS m, (doc_id * 37 % 300) * (doc_id % 7) / 60000.0 AS score FROM documents)) WHERE top >= 0.02 AND score >= 0.01")
def w4(s, d):
    rows = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", (F.col("doc_id") % 7).alias("m"), ((F.col("doc_id") * 37 % 300) * (F.col("doc_id") % 7) / 60000.0).alias("score"))
    return ranking.apply_gates(rows, ["source", "m"], "score").drop("m")


@query("w5_recent_commits", with_views("changes_v", "SELECT sha, path, rank FROM recent", RECENT_SQL))
def w5(s, d):
    return recent_files(s, d).select("sha", "path", F.col("rank").cast("long").alias("rank"))


@query("w6_pending_captures", with_views("captures_v", "SELECT id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY captured_at, id) - 1 AS rank FROM captures_v WHERE presented_at IS NULL"))
def w6(s, d):
    return ranking.pending_captures(view(s, d, "captures_v")).select("id", "project_id", F.col("rank").cast("long").alias("rank"))


RRF_SQL = "coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0)"


@query("u1_fuse_rrf", f"WITH a AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents), b AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) - 1 AS rank FROM documents) SELECT coalesce(a.source, b.source) AS source, coalesce(a.doc_id, b.doc_id) AS doc_id, round({RRF_SQL}, 9) AS rrf FROM (SELECT * FROM a WHERE rank < 10) a FULL JOIN (SELECT * FROM b WHERE rank < 10) b ON a.doc_id = b.doc_id AND a.source = b.source")
def u1(s, d):
    doc = s.read.parquet(f"{d}/documents.parquet").select("source", "doc_id", "n_chars", "lang")
    a = ranking.top_k(doc, ["source"], [F.desc("n_chars"), F.asc("doc_id")], 10)
    b = ranking.top_k(doc, ["source"], [F.asc("lang"), F.asc("doc_id")], 10)
    return ranking.fuse_rrf(a, b, ["source"], "doc_id").select("source", "doc_id", F.round("rrf", 9).alias("rrf"))


@query("u2_exclude_ids", with_views("memories_v ids_v", "SELECT id, project_id FROM memories_v m WHERE NOT EXISTS (SELECT 1 FROM ids_v i WHERE i.id = m.id AND i.project_id = m.project_id)"))
def u2(s, d):
    return ranking.exclude_ids(view(s, d, "memories_v").select("id", "project_id"), view(s, d, "ids_v"), ["project_id", "id"])


# Search

DIST_SQL = f"round({COSINE_SQL.format('q.embedding', 'v.embedding')}, 9)"
NEAR_SQL = f"near AS (SELECT * FROM (SELECT q.query_id, q.project_id, m.id, {DIST_SQL} AS dist, row_number() OVER (PARTITION BY q.query_id ORDER BY {DIST_SQL}, m.id) - 1 AS rank FROM queries_v q JOIN memories_v m ON q.project_id = m.project_id AND m.status = 'active' JOIN memory_vectors_v v ON v.memory_id = m.id AND v.embed_model = '{MODEL}') WHERE rank < 10)"
WORDS_SQL = f"words AS (SELECT query_id, project_id, id, rank FROM (SELECT q.query_id, q.project_id, m.id, row_number() OVER (PARTITION BY q.query_id ORDER BY m.created_at, m.id) - 1 AS rank FROM queries_v q JOIN memories_v m ON q.project_id = m.project_id AND m.status = 'active' WHERE contains({low('m.title')}, {low('q.keyword')}) OR contains({low('m.content')}, {low('q.keyword')}) OR coalesce(contains({low('CAST(to_json(m.facts) AS VARCHAR)')}, {low('q.keyword')}), false)) WHERE rank < 10)"
MEMORY_HITS_SQL = f"""
hits AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, {RRF_SQL} AS rrf FROM near a FULL JOIN words b ON a.query_id = b.query_id AND a.id = b.id),
scored AS (SELECT h.query_id, h.id, m.project_id, m.type, strlen(m.content) AS content_len, {RETENTION_SQL.replace('source', 'm.source')} AS retention, m.pinned, {AGE_SQL} AS age,
  round(h.rrf * ({BOOST_SQL}) * (1 + 0.3 * {RETENTION_SQL.replace('source', 'm.source')}), 9) AS score
  FROM hits h JOIN queries_v q ON q.query_id = h.query_id JOIN memories_v m ON m.id = h.id AND m.project_id = q.project_id WHERE h.query_id IN (SELECT query_id FROM near WHERE rank = 0 AND dist <= 0.38)),
memory_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM scored) WHERE rank < 5)"""


@query("v1_vector_top_k", with_views("memories_v memory_vectors_v queries_v", "SELECT query_id, project_id, id, dist, rank FROM near", NEAR_SQL))
def v1(s, d):
    own = retrieval.memory_vectors(view(s, d, "memories_v"), view(s, d, "memory_vectors_v"), MODEL)
    return vectors.vector_top_k(view(s, d, "queries_v"), own, 10, ("project_id",)).withColumn("rank", F.col("rank").cast("long"))


@query("v2_embed_text")
def v2(s, d):
    return vectors.embed_text(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "text", vectors.HashedWords()).drop("text")


@query("l1_keyword_top_k", with_views("memories_v queries_v", "SELECT * FROM words", WORDS_SQL))
def l1(s, d):
    return lexical.keyword_top_k(view(s, d, "queries_v"), view(s, d, "memories_v"), 10).withColumn("rank", F.col("rank").cast("long"))


CODE_COLUMNS = ["symbol_name", "qualified_name", "signature", "doc_comment", "body_preview"]
INDEX_SQL = f"""
toks AS (SELECT id, regexp_extract_all(lower(concat_ws(chr(10), {', '.join(CODE_COLUMNS)})), '[\\p{{L}}\\p{{N}}_]+') AS t FROM chunks_v),
flat AS (SELECT id, len(t) AS length, unnest(t) AS token FROM toks),
idx AS (SELECT token, id, length, count(*) AS tf FROM flat GROUP BY ALL)"""
BM25_SQL = """
st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM toks WHERE len(t) > 0),
dfs AS (SELECT token, count(*) AS df FROM idx GROUP BY token),
terms AS (SELECT DISTINCT query_id, lower(query_text) AS term FROM code_queries_v),
hit AS (SELECT q.query_id, d.token, d.df, count(*) AS times FROM terms q JOIN dfs d ON starts_with(d.token, q.term) GROUP BY ALL),
bm AS (SELECT query_id, id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)))), 9) AS score FROM hit JOIN idx ON hit.token = idx.token, st GROUP BY ALL),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM bm) WHERE rank < 20)"""


@query("l2_bm25_top_k", with_views("chunks_v code_queries_v", "SELECT query_id, id, score, rank FROM bm25", INDEX_SQL, BM25_SQL))
def l2(s, d):
    return lexical.bm25_top_k(view(s, d, "code_queries_v"), lexical.build_inverted_index(view(s, d, "chunks_v"), CODE_COLUMNS), 20).withColumn("rank", F.col("rank").cast("long"))


@query("r1_search_memories", with_views("memories_v memory_vectors_v queries_v", "SELECT query_id, rank, id, project_id, type, score, retention, CAST(content_len AS INTEGER) AS content_len, pinned, (NOT pinned AND retention < 0.15 AND age >= 7) AS is_stale FROM memory_hits", NEAR_SQL, WORDS_SQL, MEMORY_HITS_SQL))
def r1(s, d):
    return memory_results(s, d).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "project_id", "type", "score", "retention", "content_len", "pinned", "is_stale")


def memory_results(s, d, queries=None):
    return retrieval.search_memories(view(s, d, "queries_v") if queries is None else queries, view(s, d, "memories_v"), view(s, d, "memory_vectors_v"), NOW)


def code_tables(s, d):
    chunks, recent = view(s, d, "chunks_v"), recent_files(s, d)
    return chunks, view(s, d, "chunk_vectors_v"), lexical.build_inverted_index(chunks, CODE_COLUMNS), history.link_chunks(chunks, recent), recent.select("sha", "message").distinct()


CODE_NEAR_SQL = f"code_near AS (SELECT * FROM (SELECT q.query_id, v.chunk_id AS id, {DIST_SQL} AS dist, row_number() OVER (PARTITION BY q.query_id ORDER BY {DIST_SQL}, v.chunk_id) - 1 AS rank FROM code_queries_v q JOIN chunk_vectors_v v ON v.embed_model = '{MODEL}') WHERE rank < 20)"
CODE_HITS_SQL = f"""
cf AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, round({RRF_SQL}, 9) AS score FROM code_near a FULL JOIN bm25 b ON a.query_id = b.query_id AND a.id = b.id),
ch AS (SELECT cf.query_id, cf.id, cf.score, {BODY_HASH_SQL} AS h FROM cf JOIN chunks_v c ON c.id = cf.id),
cd AS (SELECT *, row_number() OVER (PARTITION BY query_id, h ORDER BY score DESC, id) AS n, count(*) OVER (PARTITION BY query_id, h) - 1 AS duplicate_count FROM ch),
code_hits AS (SELECT * FROM (SELECT query_id, id, score, duplicate_count, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM cd WHERE n = 1) WHERE rank < 10)"""


@query("r2_search_code", with_views("changes_v chunks_v chunk_vectors_v code_queries_v", "SELECT query_id, rank, id, score, duplicate_count FROM code_hits", INDEX_SQL, BM25_SQL, CODE_NEAR_SQL, CODE_HITS_SQL))
def r2(s, d):
    return retrieval.search_code(view(s, d, "code_queries_v"), *code_tables_for_search(s, d)).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "score", "duplicate_count")


def code_tables_for_search(s, d):
    chunks, own, index, bridge, commits = code_tables(s, d)
    return chunks, own, index, bridge, commits


MERGE_SQL = """
merged AS (SELECT query_id, 0 AS kind, id, score FROM memory_hits UNION ALL SELECT query_id, 1, id, score FROM code_hits),
gated AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM merged) WHERE top >= 0.02 AND score >= 0.01),
best AS (SELECT * FROM (SELECT query_id, kind, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, id) - 1 AS rank FROM gated) WHERE rank < 5)"""


@query("r3_search_all", with_views("memories_v memory_vectors_v queries_v changes_v chunks_v chunk_vectors_v code_queries_v", "SELECT query_id, rank, kind, id, score FROM best", NEAR_SQL, WORDS_SQL, MEMORY_HITS_SQL, INDEX_SQL, BM25_SQL, CODE_NEAR_SQL, CODE_HITS_SQL, MERGE_SQL))
def r3(s, d):
    code = retrieval.search_code(view(s, d, "code_queries_v"), *code_tables(s, d))
    return retrieval.search_all(memory_results(s, d), code)[0].select("query_id", F.col("rank").cast("long").alias("rank"), "kind", "id", "score")


@query("r3_search_all_meta", with_views("memories_v memory_vectors_v queries_v changes_v chunks_v chunk_vectors_v code_queries_v", "SELECT m.query_id, least(coalesce(g.n, 0), 5) AS returned, m.n AS total, coalesce(g.n, 0) > 5 AS truncated FROM (SELECT query_id, count(*) AS n FROM merged GROUP BY 1) m LEFT JOIN (SELECT query_id, count(*) AS n FROM gated GROUP BY 1) g ON m.query_id = g.query_id", NEAR_SQL, WORDS_SQL, MEMORY_HITS_SQL, INDEX_SQL, BM25_SQL, CODE_NEAR_SQL, CODE_HITS_SQL, MERGE_SQL))
def r3_meta(s, d):
    code = retrieval.search_code(view(s, d, "code_queries_v"), *code_tables(s, d))
    return retrieval.search_all(memory_results(s, d), code)[1]


@query("r4_similar_to_memories")
def r4(s, d):
    ids = view(s, d, "ids_v").select(F.concat(F.lit("r"), (F.col("ord") % 7).cast("string")).alias("request_id"), "project_id", "id", "ord")
    return retrieval.similar_to_memories(ids, view(s, d, "memories_v"), view(s, d, "memory_vectors_v"), *code_tables(s, d), NOW)


SYMBOL_SQL = "SELECT request_id, id, rank FROM (SELECT r.request_id, c.id, row_number() OVER (PARTITION BY r.request_id ORDER BY CASE WHEN r.file_path IS NULL THEN -c.hotspot_score END, CASE WHEN r.file_path IS NULL THEN -c.churn_count END, c.line_start, c.id) - 1 AS rank FROM reqs r JOIN chunks_v c ON (c.symbol_name = r.name OR c.qualified_name = r.name OR ends_with(c.qualified_name, '::' || r.name)) AND (r.file_path IS NULL OR r.file_path = c.file_path)) WHERE rank < 20"
REQUESTS_SQL = "reqs AS (SELECT 'y' || id AS request_id, CASE line_start % 2 WHEN 0 THEN symbol_name ELSE qualified_name END AS name, CASE WHEN line_start % 3 = 0 THEN file_path END AS file_path FROM chunks_v WHERE line_start % 20 = 1 OR line_start % 30 = 0)"


@query("r5_get_symbol", with_views("chunks_v", SYMBOL_SQL, REQUESTS_SQL))
def r5(s, d):
    return symbol_hits(s, d).select("request_id", "id", F.col("rank").cast("long").alias("rank"))


def symbol_hits(s, d):
    chunks, _, _, bridge, commits = code_tables(s, d)
    asked = chunks.filter("line_start % 20 = 1 or line_start % 30 = 0").select(F.concat(F.lit("y"), "id").alias("request_id"), F.when(F.col("line_start") % 2 == 0, F.col("symbol_name")).otherwise(F.col("qualified_name")).alias("name"), F.when(F.col("line_start") % 3 == 0, F.col("file_path")).alias("file_path"))
    return retrieval.get_symbol(asked, chunks, bridge, commits)


@query("r6_similar_to_symbols")
def r6(s, d):
    chunks, _, index, bridge, commits = code_tables(s, d)
    embedder = vectors.HashedWords()
    own = indexing.chunk_vectors(chunks, embedder)
    return retrieval.similar_to_symbols(symbol_hits(s, d), view(s, d, "memories_v"), view(s, d, "memory_vectors_v"), chunks, own, index, bridge, commits, embedder, "src0", NOW)


# Notes


def store_requests(s, d):
    """Conversations as requests to store: the session is the conversation, every third has a topic."""
    c = s.read.parquet(f"{d}/conversations.parquet")
    none = F.lit(None)
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.concat(F.lit("n"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("project_id"),
        F.lit("fact").alias("type"), F.col("role").alias("title"), F.col("text").alias("content"), F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("t"), (F.col("conv_id") % 60).cast("string"))).alias("topic_key"), F.col("conv_id").cast("string").alias("session_id"),
        F.when(F.col("turn") % 2 == 0, 0.7).alias("importance"), F.when(F.col("turn") % 3 == 0, "reviewed").alias("source"), F.when(F.col("turn") % 4 == 1, True).cast("boolean").alias("pinned"), F.array().cast("array<string>").alias("facts"), F.array("role").alias("tags"), none.cast("string").alias("extra"),
    ).drop("extra")


@query("m1_prepare_memories", f"SELECT conv_id * 1000 + turn AS ord, sha256(content) AS content_hash, CASE WHEN turn % 2 = 0 THEN 0.7 ELSE 0.5 END AS importance, CASE WHEN turn % 3 = 0 THEN 'reviewed' ELSE 'realtime' END AS source, turn % 4 = 1 AS pinned, CAST(NULL AS VARCHAR[]) AS facts, [role] AS tags FROM (SELECT *, {sanitize_sql('text')} AS content FROM conversations)")
def m1(s, d):
    return memory.prepare_memories(store_requests(s, d), NOW).select("ord", "content_hash", "importance", "source", "pinned", "facts", "tags")


def dedup_sql(window: int) -> str:
    return with_views("ingest_v", "SELECT id, kept, dup_of FROM folded", "o AS (SELECT *, row_number() OVER (PARTITION BY session_id, content ORDER BY ts, id) AS n FROM ingest_v)", f"""folded AS (
  SELECT session_id, content, n, id, ts AS last_ts, id AS last_id, true AS kept, CAST(NULL AS VARCHAR) AS dup_of FROM o WHERE n = 1
  UNION ALL
  SELECT o.session_id, o.content, o.n, o.id, CASE WHEN epoch_us(o.ts) - epoch_us(f.last_ts) >= {window}000000 THEN o.ts ELSE f.last_ts END, CASE WHEN epoch_us(o.ts) - epoch_us(f.last_ts) >= {window}000000 THEN o.id ELSE f.last_id END,
    epoch_us(o.ts) - epoch_us(f.last_ts) >= {window}000000, CASE WHEN epoch_us(o.ts) - epoch_us(f.last_ts) < {window}000000 THEN f.last_id END
  FROM folded f JOIN o ON o.session_id = f.session_id AND o.content = f.content AND o.n = f.n + 1)""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("m2_dedup_window", dedup_sql(21600))
def m2(s, d):
    return memory.dedup_window(view(s, d, "ingest_v"), None, 21600, ("session_id", "content"), "ts").select("id", "kept", "dup_of")


@query("m2_dedup_window_30s", dedup_sql(30))
def m2_short(s, d):
    return memory.dedup_window(view(s, d, "ingest_v"), None, 30, ("session_id", "content"), "ts").select("id", "kept", "dup_of")


@query("m3_upsert_topics", with_views("memories_v", """
SELECT id, project_id, topic_key, type, title, importance, status, source, pinned, upserted FROM (
  SELECT arg_min(id, o) AS id, project_id, topic_key, arg_min(type, o) AS type, arg_max(title, o) AS title, arg_max(importance, o) AS importance, arg_min(status, o) AS status,
    coalesce(arg_max(gsource, CASE WHEN gsource IS NOT NULL THEN o END), 'realtime') AS source, coalesce(arg_max(gpinned, CASE WHEN gpinned IS NOT NULL THEN o END), false) AS pinned, count(*) > 1 AS upserted
  FROM allrows WHERE topic_key IS NOT NULL GROUP BY project_id, topic_key, CASE WHEN (project_id, topic_key) IN (SELECT (project_id, topic_key) FROM c WHERE topic_key IS NOT NULL) THEN '' ELSE id END
  UNION ALL SELECT id, project_id, topic_key, type, title, importance, status, coalesce(gsource, 'realtime'), coalesce(gpinned, false), false FROM allrows WHERE topic_key IS NULL)""",
"""c AS (SELECT 'n' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, 'src' || CAST(conv_id % 20 AS VARCHAR) AS project_id, CASE WHEN conv_id % 3 = 0 THEN 't' || CAST(conv_id % 60 AS VARCHAR) END AS topic_key, role AS title, CASE WHEN turn % 2 = 0 THEN 0.7 ELSE 0.5 END AS importance,
  conv_id * 1000 + turn AS o, CASE WHEN turn % 3 = 0 THEN 'reviewed' END AS gsource, CASE WHEN turn % 4 = 1 THEN true END AS gpinned FROM conversations)""",
"""one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, topic_key ORDER BY id) AS n FROM memories_v) WHERE n = 1 OR topic_key IS NULL)""",
"allrows AS (SELECT id, project_id, topic_key, 'fact' AS type, title, importance, 'active' AS status, o, gsource, gpinned FROM c UNION ALL SELECT id, project_id, topic_key, type, title, importance, status, -1, source, pinned FROM one)"))
def m3(s, d):
    out = memory.upsert_topics(one_each(view(s, d, "memories_v")), memory.prepare_memories(store_requests(s, d), NOW))
    return out.select("id", "project_id", "topic_key", "type", "title", "importance", "status", "source", "pinned", "upserted")


def one_each(memories):
    """Notes with the rule kept that a topic stands once in a project."""
    first = ranking.top_k(memories.filter("topic_key is not null"), ["project_id", "topic_key"], [F.asc("id")], 1).drop("rank")
    full = first.unionByName(memories.filter("topic_key is null"))
    return full.withColumns({"content_hash": content_hash("content"), "updated_at": F.col("created_at")})


@query("m4_store_memories")
def m4(s, d):
    out = memory.store_memories(store_requests(s, d), one_each(view(s, d, "memories_v")), view(s, d, "memory_vectors_v"), vectors.HashedWords(), NOW)
    return out["results"]


LIST_SQL = f"""SELECT request_id, id, score, rank FROM (SELECT request_id, id, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, created_at DESC, id) - 1 AS rank FROM (
  SELECT *, {RETENTION_SQL} AS score FROM (SELECT project_id AS request_id, *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS n FROM memories_v WHERE status = 'active' AND importance >= 0.4) WHERE n <= 200) WHERE list_contains(tags, 'good')) WHERE rank < 20"""


@query("m5_list_memories", with_views("memories_v", LIST_SQL))
def m5(s, d):
    m = view(s, d, "memories_v")
    asked = m.select("project_id").distinct().select(F.col("project_id").alias("request_id"), "project_id", F.lit(None).cast("string").alias("type"), F.lit(0.4).alias("min_importance"), F.array(F.lit("good")).alias("wanted_tags"), F.lit(20).alias("limit"))
    return memory.list_memories(m, asked, NOW).select("request_id", "id", "score", F.col("rank").cast("long").alias("rank"))


STALE_SQL = f"stale AS (SELECT id, project_id, {RETENTION_SQL} AS score FROM memories_v WHERE status = 'active' AND NOT pinned AND created_at <= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND {RETENTION_SQL} < 0.15)"


@query("m6_list_stale", with_views("memories_v", "SELECT id, project_id, score FROM stale", STALE_SQL))
def m6(s, d):
    return memory.list_stale(view(s, d, "memories_v"), NOW).select("id", "project_id", "score")


@query("m7_evict_stale", with_views("memories_v memory_vectors_v", "SELECT m.id, v.memory_id IS NOT NULL AS has_vector FROM memories_v m LEFT JOIN memory_vectors_v v ON v.memory_id = m.id WHERE m.id NOT IN (SELECT id FROM stale)", STALE_SQL))
def m7(s, d):
    out = memory.evict_stale(view(s, d, "memories_v"), view(s, d, "memory_vectors_v"), NOW)
    return out["memories"].select("id").join(out["vectors"].select(F.col("memory_id").alias("id"), F.lit(True).alias("has_vector")), "id", "left").select("id", F.coalesce("has_vector", F.lit(False)).alias("has_vector"))


ASKED_SQL = "asked AS (SELECT m.id FROM memories_v m JOIN ids_v i ON i.id = m.id AND i.project_id = m.project_id)"


@query("m8_delete_memories", with_views("memories_v ids_v", "SELECT id, CASE WHEN id IN (SELECT id FROM asked) THEN 'deleted' ELSE status END AS status FROM memories_v", ASKED_SQL))
def m8(s, d):
    return memory.delete_memories(view(s, d, "memories_v"), view(s, d, "ids_v")).select("id", "status")


@query("m8_delete_report", with_views("memories_v ids_v", "SELECT i.project_id, count(m.id) AS found, count(*) AS total FROM ids_v i LEFT JOIN memories_v m ON i.id = m.id AND i.project_id = m.project_id GROUP BY 1"))
def m8_report(s, d):
    return memory.delete_report(view(s, d, "memories_v"), view(s, d, "ids_v"))


@query("m9_pin_memories", with_views("memories_v ids_v", "SELECT m.id, CASE WHEN i.id IS NOT NULL AND m.status <> 'deleted' THEN i.pin ELSE m.pinned END AS pinned FROM memories_v m LEFT JOIN ids_v i ON i.id = m.id AND i.project_id = m.project_id"))
def m9(s, d):
    return memory.pin_memories(view(s, d, "memories_v"), view(s, d, "ids_v")).select("id", "pinned")


@query("m10_touch_memories", with_views("memories_v ids_v", f"SELECT id, access_count + CASE WHEN id IN (SELECT id FROM asked) THEN 1 ELSE 0 END AS access_count, strftime(CASE WHEN id IN (SELECT id FROM asked) THEN TIMESTAMP '{NOW}' ELSE last_accessed END, '%Y-%m-%d %H:%M:%S') AS seen FROM memories_v", ASKED_SQL))
def m10(s, d):
    return memory.touch_memories(view(s, d, "memories_v"), view(s, d, "ids_v"), NOW).select("id", "access_count", F.date_format("last_accessed", "yyyy-MM-dd HH:mm:ss").alias("seen"))


@query("m11_reembed", with_views("memories_v memory_vectors_v", "SELECT memory_id, embed_model FROM memory_vectors_v WHERE memory_id NOT IN (SELECT id FROM need) UNION ALL SELECT id, 'cur-model' FROM need", f"need AS (SELECT id FROM memories_v WHERE status = 'active' AND id NOT IN (SELECT memory_id FROM memory_vectors_v WHERE embed_model = '{MODEL}'))"))
def m11(s, d):
    return memory.reembed(view(s, d, "memories_v"), view(s, d, "memory_vectors_v"), vectors.HashedWords(64, MODEL)).select("memory_id", "embed_model")


@query("m12_captures", with_views("captures_v", f"SELECT id, project_id, raw_data, strftime(CASE WHEN presented_at IS NULL AND project_id = 'u3' THEN TIMESTAMP '{NOW}' ELSE presented_at END, '%Y-%m-%d %H:%M:%S') AS shown FROM captures_v UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), 'u5', url, NULL FROM pages"))
def m12(s, d):
    notes = s.read.parquet(f"{d}/pages.parquet").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.lit("u5").alias("project_id"), F.col("url").alias("summary"), F.lit(None).cast("string").alias("context"))
    rows = memory.append_captures(view(s, d, "captures_v"), notes, NOW)
    return memory.mark_presented(rows, rows.filter("project_id = 'u3'"), NOW).select("id", "project_id", "raw_data", F.date_format("presented_at", "yyyy-MM-dd HH:mm:ss").alias("shown"))


@query("m13_session_context", with_views("memories_v", f"SELECT project_id, id, rank, coalesce(sum(n) OVER (PARTITION BY project_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 30000 AS included FROM (SELECT project_id, id, strlen(content) AS n, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, created_at DESC, id) - 1 AS rank FROM (SELECT *, {RETENTION_SQL} AS score FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS n FROM memories_v WHERE status = 'active' AND importance >= 0.4) WHERE n <= 2000)) WHERE rank < 500"))
def m13(s, d):
    return memory.session_context(view(s, d, "memories_v"), view(s, d, "captures_v"), NOW)["notes"].select("project_id", "id", F.col("rank").cast("long").alias("rank"), "included")


# Source trees and snapshots

TREE_SQL = "CASE WHEN doc_id % 11 = 0 THEN 'node_modules/' WHEN doc_id % 13 = 0 THEN 'gen/' ELSE '' END || 's' || CAST(doc_id % 5 AS {STR}) || '/d' || CAST(doc_id AS {STR}) || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.rs' WHEN 2 THEN '.lock' ELSE '.bin' END"


@query("s1_read_source_tree", f"""
SELECT path, content_hash, language, n_bytes FROM (
  SELECT doc_id, {TREE_SQL.replace("{STR}", "VARCHAR")} AS path, sha256(coalesce(text, '')) AS content_hash, CASE doc_id % 4 WHEN 0 THEN 'markdown' ELSE 'rust' END AS language, strlen(coalesce(text, '')) AS n_bytes FROM documents
) WHERE doc_id % 4 < 2 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0""")
def s1(s, d):
    """Documents written as a tree of files, and read again without what is excluded."""
    root = f"{scratch(s)}/tree"
    trees.write_source_tree(s.read.parquet(f"{d}/documents.parquet").selectExpr(f"{TREE_SQL.replace('{STR}', 'string')} as path", "text"), root)
    return trees.read_source_tree(s, root, ("gen/**",)).select("path", "content_hash", "language", F.octet_length("text").cast("long").alias("n_bytes"))


@query("s4_snapshot_tables", with_views("memories_v", "SELECT id, project_id, CASE WHEN id IN (SELECT id FROM memories_v WHERE id LIKE '%7') THEN 'changed' ELSE title END AS title, access_count FROM memories_v"))
def s4(s, d):
    """Notes as a snapshot, replaced by a version that is made from it; the newest is read."""
    root, rows = scratch(s), view(s, d, "memories_v").select("id", "project_id", "title", "access_count")
    snapshots.write_table(rows, root)
    first = snapshots.read_table(s, root)
    snapshots.write_table(first.withColumn("title", F.when(F.col("id").endswith("7"), "changed").otherwise(F.col("title"))), root, keep=1)
    return snapshots.read_table(s, root)


# The code index


def document_path():
    return F.concat(F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".md").otherwise(".sql"))


def source_files(s, d):
    """Documents as files of two kinds: Markdown with a heading for each line, and SQL."""
    doc = s.read.parquet(f"{d}/documents.parquet")
    text = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"(?m)^", "# ")).otherwise(F.replace("text", F.lit("."), F.lit(";")))
    return doc.select(document_path().alias("path"), text.alias("text")).withColumn("content_hash", content_hash("text"))


def document_changes(s, d):
    """Commits of documents' files: one that counts for every fourth, one that doesn't for every eighth."""
    doc = s.read.parquet(f"{d}/documents.parquet").filter("doc_id % 4 = 1").select("doc_id", document_path().alias("path"), F.col("n_chars").cast("long").alias("added"), F.lit(0).cast("long").alias("deleted"))
    sha = lambda c: F.substring(F.sha2(c, 256), 1, 40).alias("sha")
    at = F.expr("timestampadd(DAY, doc_id % 97, timestamp_ntz'2001-01-01 00:00:00')").alias("ts")
    one = doc.select(sha((F.col("doc_id") % 97).cast("string")), at, F.lit("a change to remember").alias("message"), "path", "added", "deleted")
    return one.unionByName(doc.filter("doc_id % 8 = 1").select(sha(F.concat(F.lit("b"), F.col("doc_id").cast("string"))), at, F.lit("bump the version again").alias("message"), "path", "added", "deleted"))


def index_rows(index):
    """Every chunk with its vectors and links, as one table to compare. All of a file meet by its path, so rows move once."""
    keys, chunk = ["file_path", "chunk_id"], F.struct("symbol_name", "line_start", "line_end", "churn_count").alias("chunk")
    parts = index["chunks"].select("file_path", F.col("id").alias("chunk_id"), chunk)
    for other in (index["vectors"].select(*keys, "embed_model"), index["bridge"].select(*keys, "commit_sha")):
        parts = parts.unionByName(other, True)
    met = parts.repartition("file_path").groupBy(*keys).agg(F.collect_list("chunk").alias("chunks"), F.collect_list("embed_model").alias("models"), F.count("commit_sha").alias("links"), F.min("commit_sha").alias("first_commit"))
    each = met.select("*", F.explode("chunks").alias("chunk")).select("*", F.explode_outer(F.array_distinct("models")).alias("embed_model"))
    count = F.when(F.col("embed_model").isNotNull(), F.size(F.filter("models", lambda m: m == F.col("embed_model")))).cast("long").alias("vectors")
    rows = each.select("file_path", "chunk.*", "links", "first_commit", "embed_model", count).join(index["files"].withColumnRenamed("path", "file_path").hint("merge"), "file_path")
    return rows.select("file_path", "content_hash", "symbol_name", "line_start", "line_end", "churn_count", "links", "first_commit", "embed_model", "vectors")


SECTIONS_SQL = """WITH f AS (SELECT source || '/d' || CAST(doc_id AS VARCHAR) || '.sql' AS path, string_split(regexp_replace(replace(text, '.', ';'), '\\r?\\n$', ''), chr(10)) AS ls FROM documents),
l AS (SELECT path, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM f),
g AS (SELECT *, sum(CASE WHEN regexp_matches(coalesce(p, ''), ';\\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, lag(line) OVER (PARTITION BY path ORDER BY pos) AS p FROM l)),
n AS (SELECT *, regexp_replace(line, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS t FROM g)
SELECT path, substring(arg_min(t, pos) FILTER (WHERE t <> ''), 1, 120) AS symbol_name, max(pos) FILTER (WHERE t <> '') AS line_end FROM n GROUP BY path, k HAVING count(*) FILTER (WHERE t <> '') > 0"""


@query("c1_chunk_sections", SECTIONS_SQL)
def c1(s, d):
    path = F.concat(F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".sql"))
    files = s.read.parquet(f"{d}/documents.parquet").select(path.alias("path"), F.replace("text", F.lit("."), F.lit(";")).alias("text"))
    return indexing.chunk_sections(files).select("path", "symbol_name", "line_end")


@query("c2_extract_symbols")
def c2(s, d):
    """Each page's words as a small Python and a small Rust file."""
    p = s.read.parquet(f"{d}/pages.parquet")
    name = F.regexp_replace("url", r"[^A-Za-z0-9]", "_")
    py = F.concat(F.lit("class C_"), name, F.lit(":\n    def m(self):\n        return 1\n\ndef f_"), name, F.lit("(a):\n    \"\"\"Doc.\"\"\"\n    return a\n"))
    rs = F.concat(F.lit("/// Doc.\npub fn f_"), name, F.lit("(a: i32) -> i32 {\n    a\n}\n\nimpl T {\n    fn m(&self) {\n    }\n}\n"))
    both = p.select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".py")).alias("path"), py.alias("text")).union(p.select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".rs")), rs))
    return indexing.extract_symbols(both)


SYMBOLS_SQL = f"""WITH found(ending, name, full_name, kind, line_start, line_end) AS (VALUES {found_sql()})
SELECT 'p' || page_id || '.' || ending AS path, replace(name, '§', CAST(page_id AS VARCHAR)) AS symbol_name, replace(full_name, '§', CAST(page_id AS VARCHAR)) AS qualified_name,
  kind AS symbol_kind, CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end FROM pages, found"""


@query("c2_symbols_by_language", SYMBOLS_SQL)
def c2_by_language(s, d):
    """Each page's number and address inside a small file of every language."""
    p = s.read.parquet(f"{d}/pages.parquet")
    number, address = F.col("page_id").cast("string"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[^\w.:/?=&-]|\*/", " ")
    kinds = F.explode(F.array(*(F.struct(F.lit(end).alias("ending"), F.lit(text).alias("sample")) for end, (text, _) in SAMPLES.items())))
    files = p.select(number.alias("number"), address.alias("address"), kinds.alias("k")).select(F.concat(F.lit("p"), "number", F.lit("."), "k.ending").alias("path"), F.replace("k.sample", F.lit("§"), F.col("number")).alias("text"), "address")
    return indexing.extract_symbols(files.select("path", F.replace("text", F.lit("^"), F.col("address")).alias("text"))).select("path", "symbol_name", "qualified_name", "symbol_kind", "line_start", "line_end")


def index_of(s, d, changes=None, held=lambda df: df):
    changes = view(s, d, "changes_v") if changes is None else changes
    chunks = view(s, d, "chunks_v")
    tables = indexing.history_tables(chunks, changes, HISTORY_NOW, held=held)
    own = view(s, d, "chunk_vectors_v")
    return tables | {"vectors": own, "files": chunks.select(F.col("file_path").alias("path"), F.lit("h").alias("content_hash")).distinct()}


@query("c3_build_index")
def c3(s, d):
    out = indexing.build_index(source_files(s, d), view(s, d, "changes_v"), vectors.HashedWords(), HISTORY_NOW, step)
    return out["chunks"].join(out["vectors"].select(F.col("chunk_id").alias("id"), "embed_model"), "id").select("id", "file_path", "symbol_name", "line_start", "line_end", "embed_model")


C4_SQL = """WITH f AS (SELECT doc_id, source || '/d' || CAST(doc_id AS VARCHAR) || CASE doc_id % 3 WHEN 0 THEN '.md' ELSE '.sql' END AS path, doc_id % 3 = 0 AS md,
  CASE doc_id % 3 WHEN 0 THEN regexp_replace(text, '(?m)^', '# ', 'g') ELSE replace(text, '.', ';') END AS text FROM documents WHERE doc_id % 7 <> 3),
s AS (SELECT *, string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10)) AS ls FROM f),
l AS (SELECT doc_id, path, md, text, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM s),
g AS (SELECT *, sum(CASE WHEN md OR regexp_matches(coalesce(p, ''), ';\\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM l)),
n AS (SELECT *, regexp_replace(line, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS t FROM g),
c AS (SELECT doc_id, path, any_value(text) AS text, substring(arg_min(t, pos) FILTER (WHERE t <> ''), 1, 120) AS symbol_name, min(pos) AS line_start, max(pos) FILTER (WHERE t <> '') AS line_end FROM n GROUP BY doc_id, path, k HAVING count(*) FILTER (WHERE t <> '') > 0)
SELECT path AS file_path, sha256(text) AS content_hash, symbol_name, line_start, line_end, CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END AS churn_count, CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END AS links,
  CASE WHEN doc_id % 4 = 1 THEN substring(sha256(CAST(doc_id % 97 AS VARCHAR)), 1, 40) END AS first_commit, 'hashed-words-1' AS embed_model, 1 AS vectors FROM c"""


@query("c4_update_index", C4_SQL)
def c4(s, d):
    files, embedder, changes = source_files(s, d), vectors.HashedWords(), document_changes(s, d)
    number = F.regexp_extract("path", r"/d(\d+)", 1).cast("long")
    before = files.filter(number % 7 != 5).withColumn("text", F.when(number % 7 == 2, F.lit("# old\n")).otherwise(F.col("text"))).withColumn("content_hash", content_hash("text"))
    # Sections are cut once for all tables that are made of them.
    index = indexing.build_index(before, changes, embedder, HISTORY_NOW, step)
    return index_rows(indexing.update_index(index, files.filter(number % 7 != 3), None, embedder, HISTORY_NOW, held=step))


@query("c5_apply_commits", with_views("changes_v chunks_v", f"""
SELECT c.id, CASE WHEN c.file_path IN (SELECT path FROM new) THEN coalesce(h2.n, 0) ELSE coalesce(hot.churn_count, 0) END AS churn_count, CASE WHEN c.file_path IN (SELECT path FROM new) THEN coalesce(h2.w, 0.0) ELSE coalesce(hot.hotspot_score, 0.0) END AS hotspot_score
FROM chunks_v c LEFT JOIN hot ON hot.path = c.file_path LEFT JOIN h2 ON h2.path = c.file_path""", RECENT_SQL, HOTSPOT_SQL,
"new AS (SELECT DISTINCT path FROM changes_v WHERE ts >= TIMESTAMP '2001-07-30 00:00:00')",
f"h2 AS (SELECT path, count(*) AS n, round(sum({commit_weight_sql(HISTORY_NOW)}), 9) AS w FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, sha) AS k FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, sha) AS r FROM f) WHERE r <= 150 AND {SIGNIFICANT_SQL}) WHERE k <= 50 GROUP BY path)"))
def c5(s, d):
    changes, recent = view(s, d, "changes_v"), "timestamp_ntz'2001-07-30 00:00:00'"
    out = history.apply_commits(index_of(s, d, changes.filter(f"ts < {recent}")), changes.filter(f"ts >= {recent}"), HISTORY_NOW)
    return out["chunks"].select("id", "churn_count", "hotspot_score")
