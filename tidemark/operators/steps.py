"""Jobs in steps: what a step gives is written where the cluster shares files and read again.

A plan of all steps at once holds every shuffle of all of them, computes what several steps read once for each, and keeps the
driver busy with its text whenever a stage ends; with tables between the steps the driver holds one step's plan at a time.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffles of a query go when it ends, and not only when the driver happens to collect its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, path: str, *by: str) -> None:
    """Writes rows that later steps read, beside what is there: packed well, and their shuffles released at once."""
    conf = df.sparkSession.conf
    before = conf.get(RELEASE, "false")
    conf.set(RELEASE, "true")
    try:
        df.write.mode("append").option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        conf.set(RELEASE, before)


def scratch(spark: SparkSession) -> str:
    """A new folder where the cluster shares files, below spark.checkpoint.dir; a temporary one only if that is
    unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return f"{base.rstrip('/')}/query-{uuid.uuid4().hex}"


def step(df: DataFrame) -> DataFrame:
    """The rows, written and read again."""
    path = scratch(df.sparkSession)
    save(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
