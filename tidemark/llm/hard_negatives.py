"""Hard negatives by slots: for anchors and their nearest rows of the same label, the best rows of other labels whose
scores lie in a window below each positive's.

Scores are inner products of whole-numbered vectors. Anchors and rows are dealt into blocks by hash, and a cell is a
block of each.

1. Positives: anchors meet the rows of their own label only, in cells of one label; every cell gives an anchor's best,
   and the best of these are its positives.
2. Slots: a positive's window goes from `low` to `high` percent of its score. The upper limits of an anchor's windows,
   taken in falling order, split the scores below the first into disjoint slots; a slot reaches down to the next limit.
   In every cell a combiner keeps the best `negatives` of each slot, so what leaves a cell doesn't grow with its rows.
3. Merging: the best of each slot over all cells are found first. A window is its own slot and all those after it, so
   each slot's rows go to the windows of its own and of the earlier slots; of what a window gets this way the best that
   reach its lower limit are the answer. Windows overlap, but no score is computed or kept for more than one slot.

The work is that of the stated anchors against all rows. Vectors travel as packed bytes, of 1, 2 or 4 for a component.
Nothing is broadcast; a label with most rows has more blocks.

Cases: a row whose id, label or vector is null, whose vector is empty, or that has a null or non-finite component, or one
beyond MOST after scaling, takes no part. Rows of one id fold into one, the least by label and packed vector. Vectors of several
lengths only meet those of their own. An anchor without other rows of its label has no positives and no result; a
positive whose score is negative has an empty window. Ties go to the smaller id. Other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, table

#: Rows and anchors of a block; scores that a task holds at once.
ROWS, ANCHORS, AT_ONCE = 8192, 4096, 1 << 22
#: Components after scaling are below this: a hundred times the product of rows of up to 2048 components fits a long.
MOST = 1 << 22
WIDTHS = ((1, np.int8), (2, np.int16), (4, np.int32))


def packed(v: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as bytes of the least width that holds the row."""
    top = np.abs(v).max(1, initial=0)
    out: list[bytes] = [b""] * len(v)
    for width, kind in WIDTHS:
        low, high = (0 if width == 1 else 1 << 4 * width - 1), 1 << 8 * width - 1
        for n in np.flatnonzero((top >= low) & (top < high)):
            out[n] = bytes([width]) + v[n].astype(kind).tobytes()
    return out


def unpacked(column: pa.ChunkedArray) -> np.ndarray:
    """The matrix of packed rows of one length."""
    rows = column.to_pylist()
    kinds = dict(WIDTHS)
    return np.stack([np.frombuffer(r, kinds[r[0]], offset=1) for r in rows]).astype(np.int32)


def pack_rows(df: DataFrame, scale: float) -> DataFrame:
    """(id, label, dims, v) of rows (id, label, e) that take part."""
    usable = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < MOST))
    whole = df.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & usable)
    whole = whole.select("id", "label", F.transform("e", lambda x: F.floor(x * scale).cast("int")).alias("v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(sizes)])
            held: list[bytes] = [b""] * len(sizes)
            for dims in np.unique(sizes):
                rows = np.flatnonzero(sizes == dims)
                for n, b in zip(rows, packed(flat[starts[rows][:, None] + np.arange(dims)]), strict=True):
                    held[n] = b
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(sizes, pa.int32()), pa.array(held, pa.binary())], names=["id", "label", "dims", "v"])

    once = whole.mapInArrow(work, "id long, label long, dims int, v binary")
    return once.groupBy("id").agg(F.min(F.struct("label", "dims", "v")).alias("r")).select("id", "r.*")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices, exactly: in floats where no sum can leave their whole numbers."""
    top = np.sqrt((a.astype(np.float64) ** 2).sum(1).max(initial=0)) * np.sqrt((b.astype(np.float64) ** 2).sum(1).max(initial=0))
    kind = np.float32 if top < 2**23 else np.float64 if top < 2**52 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def block(c: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(c), n).cast("int")


def in_cells(rows: DataFrame, anchors: DataFrame, of: list[str], work: Callable, schema: str) -> DataFrame:
    """work(rows, anchors) in every cell: of one value of the columns `of`, a block of rows and a block of anchors."""
    sizes = lambda df, most, name: df.groupBy(*of).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    blocks = sizes(rows, ROWS, "nx").join(sizes(anchors, ANCHORS, "na"), of)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    x = rows.join(blocks, of).withColumns({"xb": block("id", F.col("nx")), "ab": every("na")}).drop("nx", "na")
    a = anchors.join(blocks, of).withColumns({"ab": block("id", F.col("na")), "xb": every("nx")}).drop("nx", "na")
    a = a.select(*(F.col(c).alias(f"a_{c}") for c in a.columns))
    keys = [*of, "xb", "ab"]
    return x.groupBy(*keys).cogroup(a.groupBy(*(f"a_{c}" for c in keys))).applyInArrow(work, schema)


def scores_of(rows: pa.Table, anchors: pa.Table) -> Iterator[tuple[slice, np.ndarray]]:
    """(part, scores): anchors of a part against all rows."""
    x, a = unpacked(rows.column("v")), unpacked(anchors.column("a_v"))
    step = max(1, AT_ONCE // len(x))
    for at in range(0, len(a), step):
        yield slice(at, at + step), products(a[at : at + step], x)


def best_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's k best, by score and then by smaller id."""
    order = np.lexsort((ids, -score, group))
    group = group[order]
    return order[np.arange(len(group)) - np.searchsorted(group, group) < k]


def result(names: list[str], parts: list[tuple[np.ndarray, ...]]) -> pa.Table:
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})


def nearest_positives(k: int) -> Callable:
    def work(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        parts = []
        if rows.num_rows and anchors.num_rows:
            ids, own = rows.column("id").to_numpy(), anchors.column("a_id").to_numpy()
            for part, scores in scores_of(rows, anchors):
                take = min(k + 1, len(ids))
                edge = np.partition(scores, len(ids) - take, axis=1)[:, len(ids) - take]  # one more, for the anchor itself
                n, j = np.nonzero(scores >= edge[:, None])
                other = own[part][n] != ids[j]
                n, j = n[other], j[other]
                kept = best_of(n, scores[n, j], ids[j], k)
                n, j = n[kept], j[kept]
                parts.append((own[part][n], ids[j], scores[n, j]))
        return result(["anchor_id", "positive_id", "positive_score"], parts)

    return work


def slot_of(score: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The last of each row's limits (in falling order) that the score doesn't pass; -1 if it passes the first."""
    return (score[:, None] <= limits).sum(1) - 1


def best_in_slots(k: int) -> Callable:
    """Of each anchor and slot, a cell's k best rows of other labels that some window takes."""

    def work(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        parts = []
        if rows.num_rows and anchors.num_rows:
            ids, label = rows.column("id").to_numpy(), rows.column("label").to_numpy()
            own, own_label = anchors.column("a_id").to_numpy(), anchors.column("a_label").to_numpy()
            held = [anchors.column(c).to_pylist() for c in ("a_upper", "a_lower")]
            width = max(map(len, held[0]))
            # A missing window has an upper limit below every score, and a lower one above.
            upper, lower = (np.array([x + [gap] * (width - len(x)) for x in side]) for side, gap in zip(held, (-(2**62), 2**62), strict=True))
            for part, scores in scores_of(rows, anchors):
                up, low = upper[part], lower[part]
                n, j = np.nonzero((scores <= up[:, :1]) & (scores >= low.min(1)[:, None]) & (label != own_label[part][:, None]))
                s = scores[n, j]
                slot = slot_of(s, up[n])
                fits = s >= low[n, slot]
                n, j, s, slot = n[fits], j[fits], s[fits], slot[fits]
                kept = best_of(n * width + slot, s, ids[j], k)
                parts.append((own[part][n[kept]], slot[kept], ids[j[kept]], s[kept]))
        return result(["anchor_id", "slot", "negative_id", "negative_score"], parts)

    return work


def ranked(df: DataFrame, by: list[str], score: str, id_column: str, k: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc(score), F.asc(id_column))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(df: DataFrame, is_anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str | Column = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (a row whose id meets
    is_anchor) and each of its `positives` best rows of the same label, the `negatives` best rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score; low and high are whole, from 0 on."""
    with Scratch(df.sparkSession, "negatives") as s:
        label = F.col(label_column) if isinstance(label_column, str) else label_column
        rows = s.write(pack_rows(df.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_column).cast("array<double>").alias("e")), scale), "rows")
        anchors = rows.filter(is_anchor(F.col("id")))
        near = in_cells(rows, anchors, ["dims", "label"], nearest_positives(positives), "anchor_id long, positive_id long, positive_score long")
        # Slots follow falling upper limits, so the best positive's window is the first.
        held = s.write(ranked(near, ["anchor_id"], "positive_score", "positive_id", positives).filter("positive_score >= 0").withColumn("slot", (F.col("rank") - 1).cast("long")), "positives")
        limits = held.withColumns({"upper": F.expr(f"(positive_score * {high}) div 100"), "lower": F.expr(f"(positive_score * {low} + 99) div 100")})
        windows = limits.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("slot", "upper", "lower"))).alias("w"))
        asked = anchors.join(windows.select(F.col("anchor_id").alias("id"), "w.upper", "w.lower"), "id")
        found = in_cells(rows, s.write(asked, "anchors"), ["dims"], best_in_slots(negatives), "anchor_id long, slot long, negative_id long, negative_score long")
        slots = s.write(ranked(found, ["anchor_id", "slot"], "negative_score", "negative_id", negatives).drop("rank"), "slots")
        # Every slot's rows go to the windows that hold it: its own and those before.
        merged = slots.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slot")))).join(held.select("anchor_id", "slot", "positive_id", "positive_score"), ["anchor_id", "slot"])
        inside = merged.filter(f"{low} * positive_score <= 100 * negative_score and 100 * negative_score <= {high} * positive_score")
        best = ranked(inside, ["anchor_id", "slot", "positive_id"], "negative_score", "negative_id", negatives)
        return s.finish(best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, label_column=label)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""
