"""Ranks, gates, budgets and unions of ranked lists. All are windows or equi-joins on the stated keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import is_significant

RRF_K = 60
MIN_TOP, MIN_SCORE = 0.020, 0.010
CONTEXT_BUDGET = 30_000
#: Shares into which the rows of a key are dealt where all pairs are asked for.
SHARES = 256


def growing(df: DataFrame) -> DataFrame:
    """A side of a join that is never sent whole through the driver. Spark takes a table that is made of a small file for
    small, though its rows were exploded or pack well."""
    return df.hint("merge")


def paired(few: DataFrame, many: DataFrame, key: str, many_id: str) -> DataFrame:
    """All pairs of rows of one key. The many are dealt by id into SHARES of their key, and the few go to each share, so that
    a key with most rows is the work of many tasks. The number of tasks is stated, since Spark would join tasks of little
    input, whatever they give."""
    n = int(few.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = few.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).repartition(n, key, "_share")
    right = many.withColumn("_share", F.pmod(F.xxhash64(many_id), F.lit(SHARES)).cast("int")).repartition(n, key, "_share")
    return growing(left).join(right, [key, "_share"]).drop("_share")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 0. The order should be total. The filter is on the row number itself:
    only then Spark drops what can't be among the first k of a group before rows are shuffled."""
    number = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn(rank_col, number).filter(F.col(rank_col) <= k).withColumn(rank_col, F.col(rank_col) - 1)


def collapse_duplicates(df: DataFrame, by: list[str], hash_col: str, order: list[Column]) -> DataFrame:
    """The best row of each group and hash, with the number of the others as duplicate_count."""
    same = W.partitionBy(*by, hash_col)
    return df.withColumns({"_n": F.row_number().over(same.orderBy(*order)), "duplicate_count": F.count(F.lit(1)).over(same) - 1}).filter("_n = 1").drop("_n")


def pack_budget(df: DataFrame, by: list[str], order: list[Column], len_col: str, budget: int = CONTEXT_BUDGET) -> DataFrame:
    """Adds included: in order, rows while the total before them is below the budget; the row that crosses it still is."""
    before = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("included", F.coalesce(F.sum(len_col).over(before), F.lit(0)) < budget)


def apply_gates(df: DataFrame, by: list[str], score: str, min_top: float = MIN_TOP, min_score: float = MIN_SCORE) -> DataFrame:
    """Groups whose best score is below min_top go whole; then rows below min_score go."""
    return df.withColumn("_top", F.max(score).over(W.partitionBy(*by))).filter((F.col("_top") >= min_top) & (F.col(score) >= min_score)).drop("_top")


def recent_commits(commit_files: DataFrame, n: int = 10, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """The newest n significant commits of each file among its newest 3n commits."""
    newest = [F.desc("ts"), F.asc("sha")]
    near = top_k(commit_files, list(by), newest, 3 * n, "_r").drop("_r")
    return top_k(near.filter(is_significant("message")), list(by), newest, n, "rank")


def pending_captures(captures: DataFrame) -> DataFrame:
    """Captures not yet presented, in time order inside their project."""
    place = F.row_number().over(W.partitionBy("project_id").orderBy("captured_at", "id")) - 1
    return captures.filter("presented_at is null").withColumn("rank", place)


def fuse_rrf(a: DataFrame, b: DataFrame, by: list[str], id_col: str, k: int = RRF_K, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each id of either ranked list once, with rank_a, rank_b and rrf = 1/(k+rank_a) + 1/(k+rank_b), a missing rank
    giving 0. keep: further columns of the first list."""
    left, right = a.select(*by, id_col, F.col("rank").alias("rank_a"), *keep), b.select(*by, id_col, F.col("rank").alias("rank_b"))
    part = lambda r: F.coalesce(1.0 / (F.lit(k) + F.col(r)), F.lit(0.0))
    return left.join(right, [*by, id_col], "full_outer").withColumn("rrf", part("rank_a") + part("rank_b"))


def exclude_ids(df: DataFrame, ids: DataFrame, by: list[str]) -> DataFrame:
    return df.join(ids.select(*by).distinct(), by, "left_anti")
