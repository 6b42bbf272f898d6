"""Exact top-k search by inner product, in three phases with one threshold for all score lists.

A vector's dimensions are cut into slices; for a query, a slice gives every candidate a partial score, which is a score
list, and a candidate's score is the sum over the lists. Candidates and queries are dealt into blocks by hash, and a
cell is a block of each.

1. Every cell gathers, from the heads of its local lists, the exact totals of the best entries, and the sum of its
   lists' highest scores, which bounds every total in the cell. The k-th best total of a query over all cells is a safe
   cutoff: k candidates reach it.
2. The cutoff goes with the query to the cells whose bound reaches it; the others hold nothing of use and see neither
   the query nor a product with it. With each list shifted by its least score in the cell, an entry whose total reaches
   the cutoff has some list in which it reaches an equal share of the shifted cutoff, so the entries at or above that
   share suffice; all others are left unresolved.
3. For these the remaining partial scores are resolved exactly, and those at or above the cutoff are ranked.

Data move once a phase: in the first each candidate block to every query block and the reverse, since the work is that
of the stated queries against all rows, in the second only blocks with a query left, and queries to their cells; only
entries of a cell's top k and those that reach the cutoff leave it. Nothing is broadcast by request.

Cases: a vector that is null, empty or has null or non-finite components takes no part, neither as query nor as
candidate; nor does a null id. Rows of one id fold into the least vector. Vectors of several lengths only meet those
of their own. A query with fewer than k candidates returns all; ties go to the smaller id. Scores that a double can't
hold exactly are summed in 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

#: Rows of a block of candidates, and of queries; slices (score lists) of a vector.
ROWS, QUERIES, LISTS = 8192, 1024, 2
#: Queries whose scores are held at once.
AT_ONCE = 128


def integer_vectors(df: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of every component as long; rows without a usable vector are left out."""
    usable = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("e"))
        .filter(F.col("id").isNotNull() & (F.size("e") > 0) & usable)
        .select("id", F.transform("e", lambda x: F.floor(x * scale)).alias("v"))
        .groupBy("id")
        .agg(F.min("v").alias("v"))
    )


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    flat = whole.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(whole), -1)


def slices_of(q: np.ndarray, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each slice of both sides, as doubles if every partial and whole score is exact in them, else as longs."""
    top = max(1, int(np.abs(q).max(initial=0))) * max(1, int(np.abs(x).max(initial=0))) * q.shape[1]
    if top < 2**53:
        q, x = q.astype(np.float64), x.astype(np.float64)
    cuts = np.array_split(np.arange(q.shape[1]), min(LISTS, q.shape[1]))
    return [(q[:, c], x[:, c].T) for c in cuts]


def block(n: int) -> Column:
    """A row's block of n, by its id."""
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


def dealt(vectors: DataFrame, queries: DataFrame, nx: int, nq: int) -> tuple:
    """Both sides of phase 1 in cells: (xb, qb, dims, id, v) and (q_xb, q_qb, q_dims, query_id, q)."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = vectors.withColumns({"xb": block(nx), "dims": F.size("v")}).withColumn("qb", every(nq))
    q = queries.withColumns({"q_qb": block(nq), "q_dims": F.size("v")}).withColumn("q_xb", every(nx)).withColumnsRenamed({"id": "query_id", "v": "q"})
    return x, q


def in_cells(x: DataFrame, q: DataFrame, work, schema: str) -> DataFrame:
    return x.groupBy("xb", "qb", "dims").cogroup(q.groupBy("q_xb", "q_qb", "q_dims")).applyInArrow(work, schema)


def top_totals(k: int):
    """Phase 1 in a cell: of each query, the k best totals among the heads of its local lists, each with the cell's block
    of candidates and the bound of its totals."""

    def gather(xs: pa.Table, qs: pa.Table) -> pa.Table:
        ids, totals, bounds = [], [], []
        if xs.num_rows and qs.num_rows:
            own, query = xs.column("id").to_numpy(), qs.column("query_id").to_numpy()
            parts = slices_of(matrix(qs.column("q")), matrix(xs.column("v")))
            place = {int(i): n for n, i in enumerate(own)}
            for at in range(0, len(query), AT_ONCE):
                lists = [q[at : at + AT_ONCE] @ x for q, x in parts]
                bound = sum(s.max(1) for s in lists).astype(np.int64).tolist()
                take = min(k + 1, len(own))
                heads = np.concatenate([np.argpartition(-s, take - 1, axis=1)[:, :take] for s in lists], axis=1)
                for n, i in enumerate(query[at : at + AT_ONCE].tolist()):
                    mine = np.setdiff1d(heads[n], [place[i]] if i in place else []).astype(np.int64)
                    best = np.sort(sum(s[n, mine] for s in lists))[::-1][:k]
                    ids += [i] * len(best)
                    bounds += [bound[n]] * len(best)
                    totals += best.astype(np.int64).tolist()
        xb = xs.column("xb")[0].as_py() if ids else 0
        return pa.table({"query_id": pa.array(ids, pa.int64()), "xb": pa.array([xb] * len(ids), pa.int32()), "bound": pa.array(bounds, pa.int64()), "total": pa.array(totals, pa.int64())})

    return gather


def sufficient(k: int):
    """Phases 2 and 3 in a cell: entries that reach the uniform threshold in a list, resolved, if they reach the cutoff."""

    def resolve(xs: pa.Table, qs: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
        if xs.num_rows and qs.num_rows:
            own, query, cut = xs.column("id").to_numpy(), qs.column("query_id").to_numpy(), qs.column("cutoff").to_numpy()
            parts = slices_of(matrix(qs.column("q")), matrix(xs.column("v")))
            for at in range(0, len(query), AT_ONCE):
                lists = [q[at : at + AT_ONCE] @ x for q, x in parts]
                least = [s.min(1) for s in lists]
                share = (cut[at : at + AT_ONCE] - sum(least)) / len(lists)
                reach = np.zeros(lists[0].shape, bool)
                for s, low in zip(lists, least, strict=True):
                    reach |= s >= (low + np.floor(share))[:, None]
                n, j = np.nonzero(reach)
                total = sum(s[n, j] for s in lists).astype(np.int64)
                keep = (total >= cut[at + n]) & (query[at + n] != own[j])
                n, j, total = n[keep], j[keep], total[keep]
                order = np.lexsort((own[j], -total, n))
                n, j, total = n[order], j[order], total[order]
                first = np.searchsorted(n, n)
                head = np.arange(len(n)) - first < k
                out.append((query[at + n[head]], own[j[head]], total[head]))
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.int64())})

    return resolve


def exact_top_k(df: DataFrame, is_query, k: int = 20, scale: float = 64.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id meets is_query (a function of the id column), the k best
    of all other rows."""
    vectors = written(integer_vectors(df, id_column, vector_column, scale), "topk-vectors")
    queries = vectors.filter(is_query(F.col("id")))
    nx, nq = -(-vectors.count() // ROWS) or 1, -(-queries.count() // QUERIES) or 1
    x, q = dealt(vectors, queries, nx, nq)
    gathered = written(in_cells(x, q, top_totals(k), "query_id long, xb int, bound long, total long"), "topk-heads")
    best = W.partitionBy("query_id").orderBy(F.desc("total"))
    kth = gathered.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).groupBy("query_id").agg(F.min("total").alias("low"), F.count(F.lit(1)).alias("n"))
    # With fewer than k candidates known, nothing is safe to leave out.
    cutoffs = kth.select("query_id", F.when(F.col("n") == k, F.col("low")).otherwise(-(2**62)).alias("cutoff"))
    bounds = gathered.groupBy("query_id", F.col("xb").alias("q_xb")).agg(F.max("bound").alias("bound"))
    alive = bounds.join(cutoffs, "query_id").filter(F.col("bound") >= F.col("cutoff")).select("query_id", "q_xb", "cutoff")
    own = queries.select(F.col("id").alias("query_id"), block(nq).alias("q_qb"), F.size("v").alias("q_dims"), F.col("v").alias("q"))
    q = written(own.join(alive, "query_id"), "topk-cutoffs")
    meet = q.select(F.col("q_xb").alias("xb"), F.col("q_qb").alias("qb"), F.col("q_dims").alias("dims")).distinct()
    x = vectors.withColumns({"xb": block(nx), "dims": F.size("v")}).join(meet, ["xb", "dims"])
    found = in_cells(x, q, sufficient(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
