"""Tables as Parquet snapshots: each write goes to a new version, so a job may read what it replaces."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] | None = None, keep: int | None = None) -> str:
    """Writes a new version below path and gives its place. Its name sorts after all before it. A table with a project
    is partitioned by it unless told otherwise; with `keep`, versions before the last `keep` are removed."""
    spark = df.sparkSession
    by = partition_by if partition_by is not None else tuple(c for c in ("project_id",) if c in df.columns and len(df.columns) > 1)
    row = spark.range(1).select(F.unix_micros(F.current_timestamp()).alias("t")).first()
    version = f"{path.rstrip('/')}/v={row.t:020d}-{uuid.uuid4().hex[:8]}"
    (df.repartition(*by).write.partitionBy(*by) if by else df.write).parquet(version)
    if keep is not None:
        remove_old(spark, path, keep)
    return version


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def files_below(spark: SparkSession, path: str) -> list[str]:
    """Folders right below a path, by name."""
    fs, where = file_system(spark, path)
    return sorted(x.getPath().toString() for x in fs.listStatus(where) if x.isDirectory()) if fs.exists(where) else []


def bytes_below(spark: SparkSession, path: str) -> int:
    fs, where = file_system(spark, path)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def remove(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def versions(spark: SparkSession, path: str) -> list[str]:
    """All whole versions, oldest first."""
    found = files_below(spark, path)
    fs, _ = file_system(spark, path)
    return [x for x in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{x}/_SUCCESS"))]


def remove_old(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Removes all but the last `keep` whole versions, and what was left unfinished before them; gives those kept."""
    kept = versions(spark, path)[-max(1, keep) :]
    for x in files_below(spark, path):
        if kept and x < kept[0]:
            remove(spark, x)
    return kept


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest version."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no version of {path}")
    return spark.read.parquet(found[-1])


def seed_copy(src: dict[str, DataFrame], dst: dict[str, DataFrame], force: bool = False) -> dict[str, DataFrame]:
    """Destination tables after a copy from a source: memories and captures that aren't there by id are added, vectors
    replaced by (memory_id, embed_model); counts says how many. Refuses a destination with memories unless forced; even
    then what is there stays."""
    if not force and dst["memories"].limit(1).count():
        raise ValueError("the destination has memories; pass force=True to add to them")
    out, counts = {}, []
    for name in ("memories", "captures"):
        new = src[name].join(dst[name].select("id"), "id", "left_anti").select(*dst[name].columns)
        out[name] = dst[name].unionByName(new)
        counts.append(new.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("copied")))
    key = ["memory_id", "embed_model"]
    out["vectors"] = dst["vectors"].join(src["vectors"].select(*key), key, "left_anti").unionByName(src["vectors"].select(*dst["vectors"].columns))
    counts.append(src["vectors"].agg(F.lit("vectors").alias("table"), F.count(F.lit(1)).alias("copied")))
    out["counts"] = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return out


def upgrade_vectors(df: DataFrame, model: str) -> DataFrame:
    """Old vectors get the current model where they name none."""
    if "embed_model" not in df.columns:
        return df.withColumn("embed_model", F.lit(model))
    return df.withColumn("embed_model", F.when(F.coalesce("embed_model", F.lit("")) == "", model).otherwise(F.col("embed_model")))


def upgrade_memories(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the columns that a note has today, null where an old table lacks one."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns))
