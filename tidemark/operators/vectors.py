"""Vectors: exact nearest neighbours for tables of queries, the embedder plug-in, and the blob format."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import col
from tidemark.operators.ranking import top_k

#: Vectors and queries of a block; a task holds one block of each.
VECTOR_BLOCK, QUERY_BLOCK = 8192, 512
#: Decimals of a distance; ranks go by the rounded value, then by id.
EXACT = 9


class Embedder(Protocol):
    model_id: str
    dims: int

    def embed(self, texts: pd.Series) -> list[np.ndarray]: ...


class HashedWords:
    """Deterministic vectors without a model file: hashed word counts with signs, of length one."""

    def __init__(self, dims: int = 64, model_id: str = "hashed-words-1"):
        self.dims, self.model_id = dims, model_id

    def embed(self, texts: pd.Series) -> list[np.ndarray]:
        out = []
        for text in texts:
            v = np.zeros(self.dims, np.float32)
            for word in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.dims] += 1 if h >> 63 else -1
            size = np.linalg.norm(v)
            out.append(v / size if size else v)
        return out


def embed_text(df: DataFrame, text_col: str, embedder: Embedder) -> DataFrame:
    """Adds embedding and embed_model. The embedder loads once in a worker; a null text is embedded as ''."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([v.astype(np.float32) for v in embedder.embed(texts.fillna(""))], dtype=object)

    return df.withColumns({"embedding": run(F.col(text_col)), "embed_model": F.lit(embedder.model_id)})


def encode_vector(c: Column | str) -> Column:
    """Little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: np.asarray(v, "<f4").tobytes(), na_action="ignore").astype(object)

    return run(col(c))


def decode_vector(c: Column | str) -> Column:
    """The reverse; bytes after the last whole float are ignored."""

    @F.pandas_udf("array<float>")
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: np.frombuffer(b[: len(b) // 4 * 4], "<f4").astype(np.float32), na_action="ignore").astype(object)

    return run(col(c))


def unit_rows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as doubles, and each one's length; rows that are null, or of another width than the first, have length 0."""
    rows = column.to_pylist()
    width = next((len(r) for r in rows if r), 0)
    x = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        if r and len(r) == width and None not in r:
            x[k] = r
    return x, np.sqrt((x * x).sum(1))


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, scope_cols: tuple[str, ...] = (), id_col: str = "id", max_dist: float | None = None) -> DataFrame:
    """(query_id, *scope_cols, id, dist, rank): each query's k nearest vectors of its scope by cosine distance, exactly.

    Queries and vectors are dealt into blocks by hash inside their scope (of as many blocks as its size asks for), and
    every block of one side meets every block of the other once, in a matrix product; only k rows for a query leave
    a pair of blocks. Nothing is broadcast. A null or zero vector has distance 1.
    """
    scope = list(scope_cols)
    of = scope or ["_all"]
    named = lambda df: df if scope else df.withColumn("_all", F.lit(0))
    count = lambda df, size, name: df.groupBy(*of).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    q, v = named(queries).select(*of, "query_id", F.col("embedding").alias("q")), named(vectors).select(*of, F.col(id_col).alias("id"), F.col("embedding").alias("v"))
    blocks = count(q, QUERY_BLOCK, "nq").join(count(v, VECTOR_BLOCK, "nv"), of)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.join(blocks, of).select(*(F.col(s).alias(f"_{s}") for s in of), "query_id", "q", F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int").alias("_qb"), every("nv").alias("_vb"))
    right = v.join(blocks, of).select(*of, "id", "v", F.pmod(F.xxhash64("id"), F.col("nv")).cast("int").alias("vb"), every("nq").alias("qb"))
    kinds = {f.name: f.dataType.simpleString() for f in [*q.schema, *v.schema]}
    schema = ", ".join([*(f"{s} {kinds[s]}" for s in of), f"query_id {kinds['query_id']}", f"id {kinds['id']}", "dist double"])

    def nearest(qs: pa.Table, vs: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if qs.num_rows and vs.num_rows:
            (a, a_size), (b, b_size) = unit_rows(qs.column("q")), unit_rows(vs.column("v"))
            near = np.ones((len(a), len(b)))
            if a.shape[1] and a.shape[1] == b.shape[1]:
                size = np.outer(a_size, b_size)
                near = np.where(size > 0, 1 - (a @ b.T) / np.where(size > 0, size, 1), 1.0)
            near = np.round(near, EXACT) + 0.0  # no negative zero
            ids, names = np.array(vs.column("id").to_pylist(), object), qs.column("query_id").to_pylist()
            edge = np.partition(near, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
            for n, name in enumerate(names):
                hits = np.flatnonzero(near[n] <= edge[n])
                out += [(name, i, d) for d, i in sorted(zip(near[n, hits].tolist(), ids[hits].tolist(), strict=True))[:k]]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        head = {s: [vs.column(s)[0].as_py()] * len(out) if out else [] for s in of}
        return pa.table({**head, "query_id": list(columns[0]), "id": list(columns[1]), "dist": list(columns[2])}).cast(target)

    # Spark's schema of the result as Arrow's, so that empty results have their types too.
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    keys = [*of, "qb", "vb"]
    found = left.groupBy(*(f"_{x}" for x in keys)).cogroup(right.groupBy(*keys)).applyInArrow(nearest, schema)
    if max_dist is not None:
        found = found.filter(F.col("dist") <= max_dist)
    return top_k(found, ["query_id", *scope], [F.asc("dist"), F.asc("id")], k).select("query_id", *scope, "id", "dist", "rank")
