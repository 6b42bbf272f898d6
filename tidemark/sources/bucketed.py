"""Sets of tables in buckets, refreshed a few buckets at a time and published together.

Each table of a set is dealt into a fixed number of buckets by a hash of its key. A refresh writes only the buckets that
it touches, as a new version of each table, and then publishes one pointer: a small snapshot table that names, for every
table and bucket, the version that holds it. The pointer is written last and counts only when whole, so a reader sees
either all tables before a refresh or all after it, and a refresh that failed leaves nothing that is read. What the last
`keep` pointers don't name is removed, once a refresh is published. One refresh of a set runs at a time.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.operators.steps import save
from tidemark.sources.snapshots import bytes_below, files_below, read_table, remove, remove_old, write_table

BUCKETS = 64
#: What a set may hold, in bytes, for each slice of buckets that a table is written in, and the fewest buckets of one.
SLICE_BYTES, SLICE_BUCKETS = 128 << 20, 24
POINTER = "name string, bucket int, version string, schema string, buckets int"


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def pointer(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, f"{root}/pointer")


def bucket_count(spark: SparkSession, root: str) -> int:
    return pointer(spark, root).first().buckets


def read_tables(spark: SparkSession, root: str, touched: list[int] | None = None) -> dict[str, DataFrame]:
    """All tables of the newest pointer; with `touched`, only those buckets of them. Each has its bucket as a column."""
    rows = pointer(spark, root).collect()  # tables x buckets
    out = {}
    for name in sorted({r.name for r in rows}):
        own = [r for r in rows if r.name == name]
        schemas = {r.version: StructType.fromJson(json.loads(r.schema)) for r in own}  # a version may lack columns of a later one
        held = sorted((r.version, r.bucket) for r in own if r.version is not None and (touched is None or r.bucket in touched))
        whole = lambda version: StructType([*schemas[version].fields, StructField("bucket", IntegerType())])  # noqa: B023, E731
        parts = []
        for version in sorted({v for v, _ in held}):  # a version's buckets are folders of one partitioned table
            paths = [f"{root}/{name}/{version}/bucket={b}" for v, b in held if v == version]
            parts.append(spark.read.option("basePath", f"{root}/{name}/{version}").schema(whole(version)).parquet(*paths))
        table = reduce(lambda a, b: a.unionByName(b, True), parts) if parts else spark.createDataFrame([], whole(own[0].version))
        out[name] = table
    return out


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], buckets: int = BUCKETS, touched: list[int] | None = None, keep: int = 2) -> None:
    """Writes the tables (with a column bucket), which are whole for the touched buckets (all, if not given), and
    publishes them together; other buckets and tables stay as they are."""
    old = [] if touched is None else pointer(spark, root).collect()
    version = f"v={uuid.uuid4().hex}"
    # A large table is written in slices of buckets, so that the disk holds the shuffles of one slice.
    mine = list(range(buckets) if touched is None else touched)
    slices = max(1, min(bytes_below(spark, root) // SLICE_BYTES + 1, len(mine) // SLICE_BUCKETS))

    def write(name: str) -> list[tuple]:
        df = tables[name]
        schema = StructType([f for f in df.schema.fields if f.name != "bucket"])
        path = f"{root}/{name}/{version}"
        # A bucket's rows lie together, so that a version has about one file for each bucket.
        for k in range(slices):
            rows = df.select(*schema.names, "bucket")
            save((rows.filter(F.col("bucket").isin(mine[k::slices])) if slices > 1 else rows).repartition("bucket"), path, "bucket")
        there = {int(p.rsplit("=", 1)[1]) for p in files_below(spark, path) if "bucket=" in p}
        return [(name, b, version if b in there else None, schema.json(), buckets) for b in mine]

    # One after the other, so that the disk holds the shuffles of one table, and the driver its plan.
    new = [row for name in tables for row in write(name)]
    fresh = {(r[0], r[1]) for r in new}
    rows = [tuple(r) for r in old if (r.name, r.bucket) not in fresh] + new
    write_table(spark.createDataFrame(rows, POINTER).coalesce(1), f"{root}/pointer")
    vacuum(spark, root, keep)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Removes what the last `keep` pointers don't name."""
    kept = remove_old(spark, f"{root}/pointer", keep)
    rows = spark.read.schema(POINTER).parquet(*kept).select("name", "bucket", "version").distinct().collect()
    named = {(r.name, r.version, r.bucket) for r in rows}
    for name in {r.name for r in rows}:
        for path in files_below(spark, f"{root}/{name}"):
            version = path.rsplit("/", 1)[1]
            if not any(n == name and v == version for n, v, _ in named):
                remove(spark, path)
                continue
            for part in files_below(spark, path):
                if "bucket=" in part and (name, version, int(part.rsplit("=", 1)[1])) not in named:
                    remove(spark, part)
