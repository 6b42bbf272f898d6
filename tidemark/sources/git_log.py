"""Reading dumps of commit history: lines `sha|seconds|subject`, each followed by `added<TAB>deleted<TAB>path` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import lines_of


def read_git_logs(spark: SparkSession, path: str) -> DataFrame:
    """(repo, pos, line) of whole dumps, one for each repo, named by their file."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.\w+)?$", 1).alias("repo"), "value")
    return whole.select("repo", F.posexplode(lines_of("value")).alias("pos", "line"))


def parse_git_log(lines: DataFrame, order_col: str = "pos") -> DataFrame:
    """(repo, sha, ts, message, path, added, deleted). A header has three parts, the first of 40 hexadecimal digits; the
    subject may hold more bars. Counts that aren't numbers are 0, and so is a bad time; what stands before the first header
    is left out."""
    head = F.split("line", r"\|", 3)
    is_head = (F.size(head) == 3) & F.get(head, F.lit(0)).rlike("^[0-9a-fA-F]{40}$")
    whole = F.when(is_head, F.struct(F.get(head, F.lit(0)).alias("sha"), F.timestamp_seconds(F.coalesce(F.get(head, F.lit(1)).try_cast("long"), F.lit(0))).alias("ts"), F.get(head, F.lit(2)).alias("message")))
    above = W.partitionBy("repo").orderBy(order_col).rowsBetween(W.unboundedPreceding, 0)
    filled = lines.withColumns({"_is_head": is_head, "_commit": F.last(whole, ignorenulls=True).over(above), "_parts": F.split("line", "\t")})
    number = lambda n: F.coalesce(F.get("_parts", F.lit(n)).try_cast("long"), F.lit(0))
    rows = filled.filter(~F.col("_is_head") & F.col("_commit").isNotNull() & (F.size("_parts") == 3))
    return rows.select("repo", "_commit.sha", "_commit.ts", "_commit.message", F.get("_parts", F.lit(2)).alias("path"), number(0).alias("added"), number(1).alias("deleted"))
