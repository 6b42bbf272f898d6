"""All queries of the library by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from tidemark.plans import job_queries, scalar_queries, stream_queries

QUERIES: dict = {**scalar_queries.QUERIES, **job_queries.QUERIES, **stream_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**scalar_queries.SQL, **job_queries.SQL, **stream_queries.SQL}
