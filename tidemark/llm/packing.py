"""Packing: documents into optimal length buckets, and token-budget batches inside each bucket.

The lengths' global histogram goes to a dynamic program that chooses the bucket boundaries with the least padding. It has
a row for each length that occurs, so its size goes with the longest text's length and not with the number of texts.
A bucket's rows are padded to its boundary, so a batch of a token budget holds a fixed number of its rows; rows are
numbered densely inside a bucket in groups of bounded size whose offsets are running sums. Lengths are any whole
numbers; pack_documents counts words.

Cases: a null or empty text has length 0 and stands in the first bucket; a text longer than the budget is a batch of
its own; equal rows are placed apart; a null id is a row like others (its documents are told apart by their length
alone); an empty table gives no rows. Other columns may come along by `keep`; those called bucket, bucket_len,
batch_id or slot are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import table, unused, written

#: Buckets, tokens of a batch, rows of a numbered group.
BUCKETS, BUDGET, GROUP = 16, 65536, 2000


def best_boundaries(points: list[int], counts: list[int], buckets: int) -> list[int]:
    """The boundaries (each a point, the last the largest) that minimise the sum of boundary times rows, by dynamic
    programming over all cuts. A layer's cuts before a point are lines in the point's value whose lower hull gives the
    best one, so a layer takes a step a point."""
    n, c = len(points), [0]
    for k in counts:
        c.append(c[-1] + k)
    cost = [points[j] * c[j + 1] for j in range(n)]  # one bucket for points 0..j
    back = []
    for _ in range(min(buckets, n) - 1):
        new, came, hull, at = cost[:], [-1] * n, [], 0
        line = lambda i, x: cost[i] - x * c[i + 1]  # noqa: B023, E731
        for j in range(1, n):
            i = j - 1
            while len(hull) > at + 1:  # the last line is below its neighbours nowhere
                a, b = hull[-2:]
                if (cost[i] - cost[a]) * (c[b + 1] - c[a + 1]) > (cost[b] - cost[a]) * (c[i + 1] - c[a + 1]):
                    break
                hull.pop()
            hull.append(i)
            while at + 1 < len(hull) and line(hull[at + 1], points[j]) < line(hull[at], points[j]):
                at += 1
            t = line(hull[at], points[j]) + points[j] * c[j + 1]
            if t < new[j]:
                new[j], came[j] = t, hull[at]
        back.append(came)
        cost = new
    out, j = points[-1:], n - 1
    for came in reversed(back):
        if came[j] >= 0:
            j = came[j]
            out.append(points[j])
    return out[::-1]


def word_count(text):
    """Runs of characters other than ASCII white space."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+"))).cast("long")


def pack(rows: DataFrame, length: str, id_column: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Adds bucket (from 0), bucket_len, batch_id (from 0 in each bucket) and slot (from 0 in each batch) to rows."""
    point, group_, own, base = (unused(x, rows) for x in ("point", "group", "own", "base"))
    rows = rows.withColumn(point, F.greatest(F.coalesce(F.col(length), F.lit(0)).cast("long"), F.lit(1)))
    histogram = sorted((r[0], r[1]) for r in rows.groupBy(point).agg(F.count(F.lit(1)).alias("n")).collect())
    bounds = best_boundaries([p for p, _ in histogram], [n for _, n in histogram], buckets)
    if not bounds:
        return rows.drop(point).withColumns({"bucket": F.lit(0), "bucket_len": F.lit(0).cast("long"), "batch_id": F.lit(0).cast("long"), "slot": F.lit(0).cast("long")})
    inside = [sum(n for p, n in histogram if low < p <= b) for low, b in zip([0, *bounds], bounds, strict=False)]
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("bucket") + 1)
    which = F.lit(0)
    for b in bounds[:-1]:
        which = which + (F.col(point) > b).cast("int")
    rows = rows.withColumn("bucket", which)
    rows = rows.withColumn(group_, F.pmod(F.xxhash64(id_column, length), pick([-(-n // GROUP) for n in inside], "long")))
    group = W.partitionBy("bucket", group_)
    numbered = rows.withColumn(own, F.row_number().over(group.orderBy(length, id_column)) - 1)
    sizes = rows.groupBy("bucket", group_).agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("bucket").orderBy(group_).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("bucket", group_, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    at = F.col(base) + F.col(own)
    room = pick([max(1, budget // b) for b in bounds], "long")
    placed = numbered.join(offsets, ["bucket", group_]).withColumns({"bucket_len": pick(bounds, "long"), "batch_id": F.floor(at / room), "slot": F.pmod(at, room)})
    return placed.drop(point, group_, own, base)


def pack_documents(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, keep: tuple[str, ...] = ()) -> DataFrame:
    lengths = docs.select("doc_id", *keep, word_count(F.col("text")).alias("n_tokens"))
    return pack(written(lengths, "packing-lengths"), "n_tokens", "doc_id", buckets, budget)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
