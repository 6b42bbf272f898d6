"""Queries that show each column function over the given tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import render as R
from tidemark.functions import scalars as S
from tidemark.operators.lexical import keyword_hits
from tidemark.operators.ranking import paired
from tidemark.plans.views import NOW, view, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def case(column: str, values: dict, otherwise) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {otherwise} END"


def days_sql(t: str, now: str = NOW) -> str:
    return f"coalesce(((epoch_us(TIMESTAMP '{now}') - epoch_us({t})) // 1000000) / 86400.0, 0.0)"


WEIGHT_SQL = case("type", S.TYPE_WEIGHTS, S.DEFAULT_WEIGHT)
AGE_SQL = days_sql("coalesce(last_accessed, created_at)")
RETENTION_SQL = f"round(least(1.0, ({WEIGHT_SQL}) * importance * exp(-0.01 * {AGE_SQL}) + least(0.03 * ln(access_count + 1.0), 0.3) + CASE WHEN source = 'reviewed' THEN 0.1 ELSE 0.0 END), 9)"
BOOST_SQL = "CASE " + " ".join(f"WHEN ({' OR '.join(f'contains(lower(query_text), {w!r})' for w in words)}) AND type IN ({', '.join(map(repr, types))}) THEN {S.INTENT_BOOST}" for words, types in S.INTENTS) + " ELSE 1.0 END"


def low(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


LINES_SQL = "string_split(replace(regexp_replace({0}, '\\r?\\n$', ''), chr(13) || chr(10), chr(10)), chr(10))"
TRIM_SQL = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
BODY_HASH_SQL = "sha256(array_to_string(list_transform(" + LINES_SQL.format("coalesce(body_preview, '')") + ", lambda x: " + TRIM_SQL.format("x") + "), chr(10)))"


def sanitize_sql(c: str) -> str:
    for _, pattern in S.SECRETS:
        keep = pattern is S.SECRETS[-1][1]
        escaped = pattern.replace("'", "''")
        c = f"regexp_replace({c}, '{escaped}', '{chr(92) + '1' if keep else ''}{S.MARK}', 'g')"
    return c


def named(c: str, values) -> str:
    return f"{c} IN ({', '.join(repr(v) for v in values)})"


NOISE_SQL = " OR ".join(f"starts_with(lower(message), '{n}')" for n in S.NOISE)
SIGNIFICANT_SQL = f"(strlen(message) >= {S.LEAST_MESSAGE} AND NOT ({NOISE_SQL}))"


@query("p1_sanitize", f"SELECT doc_id, sha256({sanitize_sql('text')}) AS clean_sha, {sanitize_sql('text')} <> text AS changed FROM documents")
def p1(s, d):
    return s.read.parquet(f"{d}/documents.parquet").withColumn("clean", S.sanitize("text")).select("doc_id", F.sha2("clean", 256).alias("clean_sha"), (F.col("clean") != F.col("text")).alias("changed"))


@query("p2_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def p2(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", S.content_hash("text").alias("content_hash"))


@query("p3_type_weight", with_views("memories_v", f"SELECT id, CAST({WEIGHT_SQL} AS DOUBLE) AS weight FROM memories_v"))
def p3(s, d):
    return view(s, d, "memories_v").select("id", S.type_weight("type").alias("weight"))


@query("p4_days_since", with_views("memories_v", f"SELECT id, round({AGE_SQL}, 9) AS age FROM memories_v"))
def p4(s, d):
    return view(s, d, "memories_v").select("id", F.round(S.days_since(F.coalesce("last_accessed", "created_at"), NOW), 9).alias("age"))


@query("p5_retention_score", with_views("memories_v", f"SELECT id, {RETENTION_SQL} AS retention FROM memories_v"))
def p5(s, d):
    from tidemark.operators.memory import retention

    return view(s, d, "memories_v").select("id", retention(NOW).alias("retention"))


@query("p6_source_boost", with_views("memories_v queries_v", f"SELECT query_id, id, CAST({BOOST_SQL} AS DOUBLE) AS boost FROM queries_v JOIN memories_v ON queries_v.project_id = memories_v.project_id"))
def p6(s, d):
    both = paired(view(s, d, "queries_v").select("query_id", "project_id", "query_text"), view(s, d, "memories_v").select("id", "project_id", "type"), "project_id", "id")
    return both.select("query_id", "id", S.source_boost("query_text", "type").alias("boost"))


@query("p7_is_stale", with_views("memories_v", f"SELECT id, (NOT pinned AND {RETENTION_SQL} < 0.15 AND {AGE_SQL} >= 7) AS stale FROM memories_v"))
def p7(s, d):
    from tidemark.operators.memory import age_days, retention

    return view(s, d, "memories_v").withColumn("r", retention(NOW)).select("id", S.is_stale("pinned", "r", age_days(NOW)).alias("stale"))


@query("p8_keyword_match", with_views("memories_v queries_v", f"SELECT query_id, count(*) AS hits FROM queries_v q JOIN memories_v m ON q.project_id = m.project_id WHERE contains({low('m.title')}, {low('q.keyword')}) OR contains({low('m.content')}, {low('q.keyword')}) OR coalesce(contains({low('CAST(to_json(m.facts) AS VARCHAR)')}, {low('q.keyword')}), false) GROUP BY 1"))
def p8(s, d):
    # Notes of any status count here.
    return keyword_hits(view(s, d, "queries_v"), view(s, d, "memories_v").withColumn("status", F.lit("active")))


@query("p9_query_terms", "SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\\s\\p{Z}]+'), lambda w: regexp_replace(w, '[^\\p{L}\\p{N}_]', '', 'g')), lambda w: w <> '') AS terms FROM documents")
def p9(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", S.query_terms("text").alias("terms"))


@query("p10_body_hash", with_views("chunks_v", f"SELECT id, {BODY_HASH_SQL} AS body_hash FROM chunks_v"))
def p10(s, d):
    return view(s, d, "chunks_v").select("id", S.body_hash("body_preview").alias("body_hash"))


@query("p11_is_significant", with_views("changes_v", f"SELECT message, {SIGNIFICANT_SQL} AS significant, count(*) AS n FROM changes_v GROUP BY ALL"))
def p11(s, d):
    return view(s, d, "changes_v").groupBy("message", S.is_significant("message").alias("significant")).agg(F.count(F.lit(1)).alias("n"))


def commit_weight_sql(now: str) -> str:
    return f"exp(-ln(2.0) * greatest({days_sql('ts', now)}, 0.0) / 180) * least(lines / 100.0, 3.0)"


@query("p12_commit_weight", with_views("changes_v", f"SELECT sha, path, lines, round({commit_weight_sql('2001-08-01 00:00:00')}, 9) AS weight FROM (SELECT sha, path, ts, CAST(sum(added + deleted) AS BIGINT) AS lines FROM changes_v GROUP BY ALL)"))
def p12(s, d):
    from tidemark.operators.history import commit_file_stats

    return commit_file_stats(view(s, d, "changes_v")).select("sha", "path", "lines", F.round(S.commit_weight("ts", "lines", "2001-08-01 00:00:00"), 9).alias("weight"))


PATHS_SQL = "SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'src/' WHEN 1 THEN 'target/' WHEN 2 THEN 'a/node_modules/' WHEN 3 THEN 'builds/' WHEN 4 THEN '' WHEN 5 THEN '.git/x/' WHEN 6 THEN 'vendor/' ELSE 'src/dist/' END || lang || CASE doc_id % 7 WHEN 0 THEN '.min.js' WHEN 1 THEN '.rs' WHEN 2 THEN '.lock' WHEN 3 THEN '.tar.py' WHEN 4 THEN '' WHEN 5 THEN '.mdx' ELSE '.RS' END AS path FROM documents"


def paths(s, d):
    return s.sql(PATHS_SQL.replace("FROM documents", f"FROM parquet.`{d}/documents.parquet`"))


EXCLUDED_SQL = f"len(list_filter(string_split(path, '/'), lambda x: x IN ({', '.join(map(repr, S.EXCLUDED_DIRECTORIES + S.EXCLUDED_NAMES))}) OR {' OR '.join(f'ends_with(x, {e!r})' for e in S.EXCLUDED_ENDS)})) > 0"


@query("p13_is_excluded", f"SELECT doc_id, path, {EXCLUDED_SQL} AS excluded FROM ({PATHS_SQL})")
def p13(s, d):
    return paths(s, d).withColumn("excluded", S.is_excluded("path"))


@query("p14_glob_match", f"SELECT doc_id, starts_with(path, 'src/') OR path = 'src' AS in_src, path = 'en.rs' OR ends_with(path, '/en.rs') AS named, path = 'vendor/de' AS exact FROM ({PATHS_SQL})")
def p14(s, d):
    return paths(s, d).select("doc_id", S.glob_match(F.lit("src/**"), "path").alias("in_src"), S.glob_match(F.lit("**/en.rs"), "path").alias("named"), S.glob_match(F.lit("vendor\\de"), "path").alias("exact"))


LANGUAGE_SQL = "CASE regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\\.([^.]+)$', 1) " + " ".join(f"WHEN '{e}' THEN '{n}'" for n, ends in S.EXTENSIONS.items() for e in ends.split()) + " END"


@query("p15_language_of", f"SELECT doc_id, language, CASE WHEN {named('language', S.STRUCTURAL)} THEN 'structural' WHEN language IS NOT NULL THEN 'code' END AS strategy FROM (SELECT doc_id, {LANGUAGE_SQL} AS language FROM ({PATHS_SQL}))")
def p15(s, d):
    return paths(s, d).select("doc_id", S.language_of("path").alias("language")).withColumn("strategy", S.chunk_strategy("language"))


@query("p16_symbol_kind", "SELECT p_type, CASE " + " ".join(f"WHEN contains(p_type, '{a}') THEN '{b}'" for a, b in S.SYMBOL_KINDS) + " ELSE 'symbol' END AS kind, count(*) AS n FROM (SELECT lower(p_type) || CASE p_partkey % 5 WHEN 0 THEN '_method' WHEN 1 THEN '_trait_item' WHEN 2 THEN 'object' ELSE '' END AS p_type FROM part) GROUP BY ALL")
def p16(s, d):
    kind = F.concat(F.lower("p_type"), F.when(F.col("p_partkey") % 5 == 0, "_method").when(F.col("p_partkey") % 5 == 1, "_trait_item").when(F.col("p_partkey") % 5 == 2, "object").otherwise(""))
    return s.read.parquet(f"{d}/part.parquet").select(kind.alias("p_type")).groupBy("p_type", S.symbol_kind("p_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("p17_build_embed_text", with_views("chunks_v", "SELECT id, concat_ws(chr(10), symbol_kind || ': ' || symbol_name, 'File: ' || file_path, 'Signature: ' || signature, 'Doc: ' || trim(regexp_replace(doc_comment, '^(///)+', '')), body_preview) AS embed_text FROM chunks_v"))
def p17(s, d):
    return view(s, d, "chunks_v").select("id", S.build_embed_text("symbol_kind", "symbol_name", "file_path", "signature", "doc_comment", "body_preview").alias("embed_text"))


@query("p18_project_slug", "SELECT page_id, translate(regexp_replace(regexp_replace(url || '.git', '^(git@|https://|http://|ssh://)', ''), '\\.git$', ''), '/:@', '---') AS slug FROM pages")
def p18(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", S.project_slug(F.concat("url", F.lit(".git"))).alias("slug"))


@query("p19_has_all_tags", with_views("memories_v", "SELECT id, list_has_all(coalesce(tags, []), ['en', 'good']) AS both, true AS none_wanted, list_has_all(coalesce(facts, []), ['en']) AS in_facts FROM memories_v"))
def p19(s, d):
    wanted = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    return view(s, d, "memories_v").select("id", S.has_all_tags("tags", wanted("en", "good")).alias("both"), S.has_all_tags("tags", wanted()).alias("none_wanted"), S.has_all_tags("facts", wanted("en")).alias("in_facts"))


@query("p20_vector_blob", "SELECT vec_id, len(embedding) * 4 AS n_bytes, true AS same FROM embeddings")
def p20(s, d):
    from tidemark.operators.vectors import decode_vector, encode_vector

    rows = s.read.parquet(f"{d}/embeddings.parquet").withColumn("blob", encode_vector("embedding"))
    return rows.select("vec_id", F.octet_length("blob").cast("long").alias("n_bytes"), (decode_vector("blob") == F.col("embedding")).alias("same"))


COSINE_SQL = "1 - list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[])"


@query("p21_cosine_distance", f"SELECT a.vec_id AS a_id, b.vec_id AS b_id, round({COSINE_SQL.format('a.embedding', 'b.embedding')}, 9) AS dist FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 25 = 3 ")
def p21(s, d):
    """All pairs of a label, as the SQL asks; they grow with the square of the input."""
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", "embedding", S.vector_length("embedding").alias("length"))
    a = e.filter("vec_id % 25 = 3").select(F.col("vec_id").alias("a_id"), "label", F.col("embedding").alias("a"), F.col("length").alias("a_length"))
    return paired(a, e, "label", "vec_id").select("a_id", F.col("vec_id").alias("b_id"), F.round(S.cosine_distance("a", "embedding", "a_length", "length"), 9).alias("dist"))


COMPACT_SQL = "CASE WHEN pinned THEN '[stale?] ' ELSE '' END || '[' || rpad(type, 18, ' ') || ' ' || printf('%.2f', importance) || '] ' || printf('%.3f', access_count / 8.0 + 0.0001) || '  ' || id || '  ' || strftime(created_at, '%Y-%m-%d') || '  ~' || CAST(length(title) AS VARCHAR) || 'c  ' || title || chr(10)"


def compact(df):
    return R.render_compact("pinned", "type", "importance", F.col("access_count") / 8.0 + 0.0001, "id", "created_at", F.length("title"), "title")


@query("p22_render_compact", with_views("memories_v", f"SELECT id, {COMPACT_SQL} AS line FROM memories_v"))
def p22(s, d):
    m = view(s, d, "memories_v")
    return m.select("id", compact(m).alias("line"))


@query("p23_render_summary", with_views("memories_v", f"SELECT id, {COMPACT_SQL} || coalesce(array_to_string(list_transform(facts, lambda f: '  - ' || f || chr(10)), ''), '') || '  tags: ' || array_to_string(tags, ', ') || chr(10) || chr(10) AS summary FROM memories_v"))
def p23(s, d):
    m = view(s, d, "memories_v")
    return m.select("id", R.render_summary(compact(m), "facts", "tags").alias("summary"))


@query("p24_render_full", with_views("memories_v", "SELECT id, sha256('[' || type || ' ' || printf('%.2f', importance) || '] ' || title || chr(10) || 'id: ' || id || ' | ' || strftime(created_at, '%Y-%m-%d') || chr(10) || 'tags: ' || array_to_string(tags, ', ') || chr(10) || content || chr(10) || coalesce('facts: ' || array_to_string(facts, '; ') || chr(10), '') || '---' || chr(10)) AS full_sha FROM memories_v"))
def p24(s, d):
    m = view(s, d, "memories_v")
    return m.select("id", F.sha2(R.render_full("type", "importance", "title", "id", "created_at", "tags", "content", "facts"), 256).alias("full_sha"))


@query("p25_render_code", with_views("chunks_v", "SELECT id, '[' || symbol_kind || '] ' || printf('%.3f', hotspot_score / 10 + 0.0001) || '  ' || file_path || ':' || CAST(line_start AS VARCHAR) || '-' || CAST(line_end AS VARCHAR) || CASE WHEN churn_count > 0 THEN '  (+' || CAST(churn_count AS VARCHAR) || ' duplicates)' ELSE '' END || ' ' || qualified_name || chr(10) || 'Signature: ' || signature || chr(10) || coalesce('Doc: ' || trim(regexp_replace(doc_comment, '^(///)+', '')) || chr(10), '') || CASE WHEN churn_count > 0 THEN 'Churn: ' || CAST(churn_count AS VARCHAR) || ' commits' || chr(10) ELSE '' END || CASE WHEN hotspot_score > 0.01 THEN 'Hotspot: ' || printf('%.2f', hotspot_score + 0.0001) || chr(10) ELSE '' END || 'History: \"' || symbol_name || '\"' || chr(10) AS text FROM chunks_v"))
def p25(s, d):
    c = view(s, d, "chunks_v")
    text = R.render_code("symbol_kind", F.col("hotspot_score") / 10 + 0.0001, "file_path", "line_start", "line_end", "churn_count", "qualified_name", "signature", "doc_comment", "churn_count", F.when(F.col("hotspot_score") > 0.01, F.col("hotspot_score") + 0.0001).otherwise(0.0), F.array("symbol_name"))
    return c.select("id", text.alias("text"))


CUT_SQL = "substring(x, 1, 120)"


@query("p26_truncate_to_budget", f"SELECT page_id, CASE WHEN length(x) <= 120 THEN x WHEN contains({CUT_SQL}, chr(10)) THEN regexp_replace({CUT_SQL}, '\\n[^\\n]*$', '') || chr(10) || '{R.NOTICE}' || chr(10) ELSE {CUT_SQL} END AS cut FROM (SELECT page_id, replace(url || ' ' || url || ' ' || url, '/', CASE WHEN page_id % 3 = 0 THEN '/' ELSE chr(10) END) AS x FROM pages)")
def p26(s, d):
    x = F.replace(F.concat_ws(" ", "url", "url", "url"), F.lit("/"), F.when(F.col("page_id") % 3 == 0, "/").otherwise("\n"))
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", R.truncate_to_budget(x, 120).alias("cut"))
