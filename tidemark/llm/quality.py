"""Quality classifier by co-training.

Two classifiers see a document from different sides: one its text's content (shares of character classes, word and line
statistics, hashed byte pairs), one the page's metadata (source, language, stated length). Over a few rounds each labels
the documents of an unlabelled pool of which it is surest, and hands them to the other to learn from. Both are calibrated
on labelled documents that neither learnt from, and a small logistic model on the two calibrated logits, fitted there
too, scores every document.

They learn from at most about LABELLED labelled documents and a pool of about POOL, both chosen by a hash of the id.
Scoring reads whole texts.

Cases: a null or empty text is scored as text without characters; null metadata is a value of its own; ids that
are null or labels that are null or not 0 and 1 aren't learnt from; a document labelled twice counts with its least label; with
labels of one kind only, or none, nothing is rejected (score 1). Equal rows have equal scores. Columns of other
names pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, text_slices
from tidemark.llm.linear import gram_features, logistic, score, sigmoid
from tidemark.llm.shingles import words_of

#: Documents to learn from; rounds of co-training, and the pool's share that a classifier labels in a round.
LABELLED, POOL, ROUNDS, SHARE = 4000, 4000, 4, 0.05
#: How sure a classifier must be of a label that it hands on; below which score a document is rejected.
SURE, REJECT = 0.95, 0.5
PAIRS, TRIPLES, SOURCES, LANGS, LENGTHS = 256, 256, 64, 16, 24
SIGNS = np.zeros((12, 256), np.float32)
for _row, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), (32, 9), (10, 13), b"!", b"*#$%&", b"|", b".,;:", b"\"'()", b"@/\\=+<>[]{}~^_`-?", range(128, 256))):
    SIGNS[_row, list(_bytes)] = 1


def content_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics of each whole text's bytes, words and lines, and hashed byte pairs and triples."""
    n = len(offsets) - 1
    words, starts, stops, at = words_of(data, offsets)
    out = np.zeros((n, 18), np.float32)
    raw = data.tobytes()
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if a == b:
            continue
        share = SIGNS @ np.bincount(data[a:b], minlength=256).astype(np.float32) / (b - a)
        own = words[at[k] : at[k + 1]]
        sizes = (stops - starts)[at[k] : at[k + 1]]
        lines = [x for x in raw[a:b].split(b"\n") if x.strip()]
        out[k, :12] = np.sqrt(share)
        if len(own) and lines:
            out[k, 12:] = (len(np.unique(own)) / len(own), sizes.mean() / 10, sizes.std() / 10, len(set(lines)) / len(lines), np.log1p(len(own)) / 10, np.log1p((b - a) / len(lines)) / 10)
    return np.hstack([out * 2, gram_features(data, offsets, PAIRS, TRIPLES)])


def metadata_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    """A row of each page's metadata: hashed source and language, and a step for the stated length's logarithm."""
    out = np.zeros((len(source), SOURCES + LANGS + LENGTHS), np.float32)
    for k, (s, c, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        out[k, zlib.crc32(repr(s).encode()) % SOURCES] = 1
        out[k, SOURCES + zlib.crc32(repr(c).encode()) % LANGS] = 1
        out[k, SOURCES + LANGS + (0 if n is None or n < 0 else 1 + min(LENGTHS - 2, int(n).bit_length()))] = 1
    return out


def fit(docs: DataFrame, labels: DataFrame, labelled: int, pool: int, rounds: int) -> dict | None:
    """The two views' classifiers, their calibration and their combination; None if the labels can't be learnt from."""
    labels = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n_labels, n_docs = labels.count(), docs.count()
    rate_l, rate_u = min(1.0, labelled / max(1, n_labels)), min(1.0, pool / max(1, n_docs))
    spot = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1_000_000)) / 1_000_000.0
    near = max(rate_l, rate_u)
    rows = docs.filter("doc_id is not null").withColumn("spot", spot).filter(F.col("spot") < near)
    rows = rows.join(labels.withColumn("l_spot", spot).filter(F.col("l_spot") < near).drop("l_spot"), "doc_id", "left")
    rows = rows.filter(F.when(F.col("quality").isNotNull(), F.col("spot") < rate_l).otherwise(F.col("spot") < rate_u))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_slices(batches, "text"):
            x = np.hstack([content_features(data, offsets), metadata_features(*(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")))])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    chosen = rows.select("doc_id", F.col("quality").cast("int").alias("quality"), "text", "source", "lang", "n_chars")
    got = chosen.mapInArrow(features, "doc_id long, quality int, x binary").toArrow().sort_by([("doc_id", "ascending")])
    if not got.num_rows:
        return None
    quality = got.column("quality").to_pandas().to_numpy(np.float64, na_value=np.nan)
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(len(quality), -1)
    views = [x[:, : -(SOURCES + LANGS + LENGTHS)], x[:, -(SOURCES + LANGS + LENGTHS) :]]
    known = np.flatnonzero(~np.isnan(quality))
    held = known[np.arange(len(known)) % 4 == 0]  # to calibrate on
    train = known[np.arange(len(known)) % 4 != 0]
    if min((np.isin([0, 1], quality[part]).sum() for part in (held, train)), default=0) < 2:
        return None
    free = np.flatnonzero(np.isnan(quality))
    taught = [dict(zip(train.tolist(), quality[train].tolist(), strict=True)) for _ in views]

    def classifier(v: int) -> np.ndarray:
        at = np.fromiter(taught[v], np.int64)
        y = np.fromiter(taught[v].values(), np.float64)
        # A label that a classifier guessed weighs a quarter of a given one.
        return logistic(views[v][at], y, np.where(np.isnan(quality[at]), 0.25, 1.0))

    def calibrated(v: int, w: np.ndarray) -> np.ndarray:
        return logistic(score(views[v][held], w)[:, None], quality[held], ridge=1e-2)

    for _ in range(rounds):
        given = []
        for v in (0, 1):
            w = classifier(v)
            p = sigmoid(score(score(views[v][free], w)[:, None], calibrated(v, w)))
            base = float(quality[train].mean())
            for label, sure, want in ((1.0, p, base), (0.0, 1 - p, 1 - base)):
                n = max(1, round(SHARE * want * len(free)))
                best = np.argsort(-sure, kind="stable")[:n]
                given += [(1 - v, int(free[k]), label) for k in best if sure[k] >= SURE]
        for to, k, label in given:
            taught[to].setdefault(k, label)
    models = [classifier(v) for v in (0, 1)]
    scales = [calibrated(v, models[v]) for v in (0, 1)]
    logits = np.stack([score(score(views[v][held], models[v])[:, None], scales[v]) for v in (0, 1)], 1)
    return {"views": models, "scales": scales, "both": logistic(logits, quality[held], ridge=1e-2)}


def score_quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS, reject: float = REJECT) -> DataFrame:
    """All columns of docs, quality_score (0 to 1) and keep (in place of columns of these names)."""
    docs = docs.drop("quality_score", "keep")
    inputs = {"doc_id": "long", "text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    model = fit(docs.select(*(F.col(c).cast(t).alias(c) for c, t in inputs.items())), labels, labelled, pool, rounds)
    if model is None:
        return docs.withColumns({"quality_score": F.lit(1.0), "keep": F.lit(True)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text"):
            views = [content_features(data, offsets), metadata_features(*(rows.column(c).to_pylist() for c in ("source", "lang", "n_chars")))]
            logits = np.stack([score(score(x, w)[:, None], s) for x, w, s in zip(views, model["views"], model["scales"], strict=True)], 1)
            p = np.round(sigmoid(score(logits, model["both"])).astype(np.float64), 6)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(p), pa.array(p >= reject)], names=[*rows.schema.names, "quality_score", "keep"])

    from pyspark.sql.types import BooleanType, DoubleType, StructType

    return docs.mapInArrow(work, StructType([*docs.schema.fields]).add("quality_score", DoubleType()).add("keep", BooleanType()))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "quality_score", "keep")
