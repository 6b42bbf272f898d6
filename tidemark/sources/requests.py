"""Reading requests to store notes, one JSON object a line, whose values may be native or written as strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["id", "project_id", "type", "title", "content", "topic_key", "session_id", "importance", "source", "pinned", "facts", "tags"]


def read_store_requests(spark: SparkSession, path: str, default_project: str) -> DataFrame:
    return parse_store_requests(spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()), default_project)


def parse_store_requests(lines: DataFrame, default_project: str) -> DataFrame:
    """lines: ord, value. Numbers, truth values and lists come either way; what is absent has its default (tags and facts
    [], importance, source and pinned null). A line that is no JSON object has corrupt set to itself, and nulls."""
    schema = ", ".join(f"`{f}` string" for f in [*FIELDS, "_corrupt_record"])
    raw = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    text = lambda f: F.col(f"r.{f}")
    listed = lambda f: F.coalesce(F.from_json(text(f), "array<string>"), F.array().cast("array<string>"))
    plain = [text(f).alias(f) for f in FIELDS if f not in ("importance", "pinned", "facts", "tags", "project_id")]
    return raw.select(
        "ord",
        F.coalesce(text("project_id"), F.lit(default_project)).alias("project_id"),
        *plain,
        text("importance").try_cast("double").alias("importance"),
        text("pinned").try_cast("boolean").alias("pinned"),
        listed("facts").alias("facts"),
        listed("tags").alias("tags"),
        text("_corrupt_record").alias("corrupt"),
    )
