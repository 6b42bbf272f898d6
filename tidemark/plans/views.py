"""The library's tables as views over the given ones, in Spark's SQL and in DuckDB's, from one text each."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.steps import scratch as scratch

NOW, HISTORY_NOW = "2024-12-31 00:00:00", "2001-08-01 00:00:00"
MODEL = "cur-model"

VIEWS = {
    "memories_v": """
SELECT 'm' || lpad(CAST(d.doc_id AS {STR}), 9, '0') AS id, d.source AS project_id,
  CASE WHEN d.doc_id % 4 = 0 THEN 't' || CAST(d.doc_id % 40 AS {STR}) END AS topic_key,
  CASE d.doc_id % 11 WHEN 0 THEN 'decision' WHEN 1 THEN 'gotcha' WHEN 2 THEN 'preference' WHEN 3 THEN 'problem-solution'
    WHEN 4 THEN 'how-it-works' WHEN 5 THEN 'trade-off' WHEN 6 THEN 'workflow' WHEN 7 THEN 'discovery'
    WHEN 8 THEN 'what-changed' WHEN 9 THEN 'fact' ELSE 'other' END AS type,
  substring(split_part(d.text, {NL}, 1), 1, 60) AS title, d.text AS content,
  CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE {ARR}(d.lang, 'n' || CAST(d.n_chars % 5 AS {STR})) END AS facts,
  {ARR}(d.lang, CASE WHEN l.quality = 1 THEN 'good' ELSE 'plain' END) AS tags,
  CAST((d.doc_id * 7) % 10 + 1 AS DOUBLE) / 10 AS importance, (d.doc_id * 13) % 50 AS access_count,
  {TS}((d.doc_id * 7919) % 15552000) AS created_at,
  CASE WHEN d.doc_id % 3 <> 0 THEN {TS}((d.doc_id * 7919) % 15552000 + (d.doc_id % 90) * 86400) END AS last_accessed,
  d.doc_id % 17 = 0 AS pinned, CASE WHEN d.doc_id % 13 = 0 THEN 'deleted' ELSE 'active' END AS status,
  's' || CAST(d.doc_id % 7 AS {STR}) AS session_id,
  CASE WHEN d.doc_id % 5 = 0 THEN 'reviewed' ELSE 'realtime' END AS source
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "memory_vectors_v": """
SELECT 'm' || lpad(CAST(vec_id AS {STR}), 9, '0') AS memory_id,
  CASE WHEN vec_id % 10 = 9 THEN 'old-model' ELSE 'cur-model' END AS embed_model, embedding FROM embeddings""",
    "queries_v": """
SELECT 'q' || CAST(e.vec_id AS {STR}) AS query_id, d.source AS project_id,
  CASE e.vec_id % 80 WHEN 21 THEN 'why ' WHEN 41 THEN 'how ' ELSE '' END || split_part(d.text, ' ', 2) AS query_text,
  split_part(d.text, ' ', 2) AS keyword, e.embedding
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 20 = 1""",
    "changes_v": """
SELECT {SHA40}(CAST(o.o_orderkey AS {STR})) AS sha, o.o_orderdate AS ts,
  CASE o.o_orderkey % 9 WHEN 0 THEN 'bump version ' WHEN 1 THEN 'fix ' WHEN 2 THEN 'Merge branch ' ELSE 'feat: change for ' END
    || o.o_orderpriority AS message,
  'src/p' || CAST(l.l_partkey % 500 AS {STR}) || '.rs' AS path,
  CAST(l.l_quantity AS BIGINT) * 5 AS added, CAST(l.l_linenumber AS BIGINT) AS deleted
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey""",
    "chunks_v": """
SELECT 'c' || CAST(p_partkey AS {STR}) AS id, 'src/p' || CAST(p_partkey % 500 AS {STR}) || '.rs' AS file_path,
  replace(p_name, ' ', '_') AS symbol_name, p_type || '::' || replace(p_name, ' ', '_') AS qualified_name,
  'function' AS symbol_kind, 'fn ' || replace(p_name, ' ', '_') || '(size: i32)' AS signature,
  CASE WHEN p_partkey % 3 = 0 THEN '/// ' || p_brand END AS doc_comment,
  CASE WHEN p_partkey % 10 <> 0 THEN '  ' || p_name || {NL} || 'size ' || CAST(p_size AS {STR}) || '  ' END AS body_preview,
  CAST(p_partkey % 400 + 1 AS BIGINT) AS line_start, CAST(p_partkey % 400 + 1 + p_size AS BIGINT) AS line_end,
  'rust' AS language, p_partkey % 7 AS churn_count, CAST(p_partkey % 9 AS DOUBLE) / 8 AS hotspot_score FROM part""",
    "chunk_vectors_v": """
SELECT 'c' || CAST(vec_id AS {STR}) AS chunk_id, CASE WHEN vec_id % 10 = 9 THEN 'old-model' ELSE 'cur-model' END AS embed_model,
  embedding FROM embeddings""",
    "code_queries_v": """
SELECT 'q' || CAST(e.vec_id AS {STR}) AS query_id, split_part(p.p_name, ' ', 1) AS query_text, e.embedding
FROM embeddings e JOIN part p ON p.p_partkey = e.vec_id WHERE e.vec_id % 20 = 1""",
    "captures_v": """
SELECT 'k' || CAST(event_id AS {STR}) AS id, 'u' || CAST(user_id % 20 AS {STR}) AS project_id, ts AS captured_at,
  event_type AS tool_name, props AS summary, props AS raw_data,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS presented_at FROM events""",
    "ingest_v": """
SELECT CAST(event_id AS {STR}) AS id, 's' || CAST(user_id AS {STR}) AS session_id, event_type AS content, ts FROM events""",
    "ids_v": """
SELECT 'm' || lpad(CAST(doc_id + (doc_id % 2) * 500000 AS {STR}), 9, '0') AS id,
  CASE WHEN doc_id % 50 = 10 THEN 'src0' ELSE source END AS project_id, doc_id AS ord, doc_id % 20 = 0 AS pin
FROM documents WHERE doc_id % 5 = 0""",
    "hunks_v": """
SELECT {SHA40}(CAST(l_orderkey AS {STR})) AS sha, l_shipdate AS ts, 'a' || CAST(l_suppkey % 9 AS {STR}) AS author,
  'change ' || l_shipmode AS message, 'src/p' || CAST(l_partkey % 500 AS {STR}) || '.rs' AS path,
  l_orderkey % 400 AS start, l_orderkey % 400 + CAST(l_quantity AS BIGINT) AS {END} FROM lineitem""".replace("l_shipmode", "l_returnflag"),
}
DIALECTS = {
    "spark": {
        "STR": "STRING", "NL": "chr(10)", "END": "`end`",
        "ARR": r"array(\1)", "TS": r"timestampadd(SECOND, \1, TIMESTAMP_NTZ'2024-01-01 00:00:00')", "SHA40": r"substring(sha2(\1, 256), 1, 40)",
    },
    "duckdb": {
        "STR": "VARCHAR", "NL": "chr(10)", "END": '"end"',
        "ARR": r"list_value(\1)", "TS": r"(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(\1))", "SHA40": r"substring(sha256(\1), 1, 40)",
    },
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rendered(text: str, dialect: str) -> str:
    for key, value in DIALECTS[dialect].items():
        if "\\1" not in value:
            text = text.replace("{" + key + "}", value)
            continue
        while (at := text.find("{" + key + "}(")) >= 0:
            start = end = at + len(key) + 3
            depth = 1
            while depth:
                depth += {"(": 1, ")": -1}.get(text[end], 0)
                end += 1
            text = text[:at] + value.replace("\\1", text[start : end - 1]) + text[end:]
    return text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = rendered(VIEWS[name], "spark")
    for t in TABLES:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 parquet.`{sf_dir}/{t}.parquet`", text)
    return spark.sql(text)


def with_views(names: str, body: str, *more: str) -> str:
    """DuckDB SQL: body after the named views, and more CTEs, as WITH clauses."""
    ctes = [f"{n} AS ({rendered(VIEWS[n], 'duckdb')})" for n in names.split()] + list(more)
    return "WITH " + ("RECURSIVE " if "RECURSIVE" in body else "") + ",\n".join(ctes) + "\n" + body.replace("RECURSIVE", "")
