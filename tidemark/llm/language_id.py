"""Language ID by hierarchical discrimination.

A text's features are shares of hashed byte pairs and triples. One-against-rest linear support vector machines choose
the language family; inside it, one-against-one machines for each pair of its languages vote, ties going by the sum of
margins. The score is the family's and the winner's least logistic margins multiplied.

The machines learn from at most about SAMPLE rows: each language's rows are kept with a probability that depends on a
hash of the id alone, so that all languages have the same share. Prediction reads whole texts.

Cases: a null text, or one without a letter, is `und` with score 0; languages without a known family are each a family
of their own; with a single language all others are it; with none, all are `und`. Null langs and null ids aren't learnt
from; a null id isn't held out. Equal texts have equal predictions. Other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, text_slices
from tidemark.llm.linear import gram_features, score, sigmoid, svm

#: Rows to learn from, over all languages.
SAMPLE = 4000
# Languages (ISO 639-1) by family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "ur", "bn", "mr", "ne", "pa", "gu"],
}
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, families: dict[str, list[str]], sample: int) -> dict:
    """The machines, from documents with doc_id, text and lang that are not held out."""
    known = docs.filter("doc_id is not null and lang is not null and text is not null").filter(~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {"families": [], "family": [], "pairs": {}}
    rates = {lang: min(1.0, sample / len(counts) / n) for lang, n in counts.items()}
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), F.col("lang"))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_000)) < rate * 1_000_000).select("doc_id", "lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text"):
            x = gram_features(data, offsets).astype(np.float16)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "lang", "x"])

    got = chosen.mapInArrow(features, "doc_id long, lang string, x binary").toArrow().sort_by([("doc_id", "ascending")])
    lang = np.array(got.column("lang").to_pylist(), object)
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(len(lang), -1).astype(np.float32)
    family_of = {code: name for name, codes in families.items() for code in codes}
    groups: dict[str, list[str]] = {}
    for code in sorted(set(lang)):
        groups.setdefault(family_of.get(code, code), []).append(code)
    names = sorted(groups)
    family = np.array([family_of.get(c, c) for c in lang], object)
    sign = lambda mask: np.where(mask, 1.0, -1.0)
    tops = [svm(x, sign(family == n)) for n in names] if len(names) > 1 else []
    pairs = {}
    for n in names:
        for a, b in combinations(groups[n], 2):
            own = (lang == a) | (lang == b)
            pairs[a, b] = svm(x[own], sign(lang[own] == a))
    return {"families": [(n, groups[n]) for n in names], "family": tops, "pairs": pairs}


def predict(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each row of features."""
    n = len(x)
    said, sure = np.full(n, "und", object), np.zeros(n)
    if not model["families"]:
        return said, sure
    tops = np.stack([score(x, w) for w in model["family"]], 1) if model["family"] else np.full((n, 1), 40.0)
    which = tops.argmax(1)
    certain = sigmoid(2 * tops.max(1))
    for k, (_, codes) in enumerate(model["families"]):
        own = np.flatnonzero(which == k)
        margins = np.full((len(own), len(codes), len(codes)), np.inf)
        for i, j in combinations(range(len(codes)), 2):
            s = score(x[own], model["pairs"][codes[i], codes[j]])
            margins[:, i, j], margins[:, j, i] = s, -s
        votes = (margins > 0).sum(2) + 1e-3 * np.tanh(np.where(np.isinf(margins), 0, margins).sum(2))
        best = votes.argmax(1)
        said[own] = np.array(codes, object)[best]
        sure[own] = certain[own] * sigmoid(2 * margins[np.arange(len(own)), best].min(1))
    return said, sure


def identify(docs: DataFrame, families: dict[str, list[str]] | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    model = learn(docs, FAMILIES if families is None else families, sample)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text"):
            said, sure = predict(model, gram_features(data, offsets))
            raw = data.tobytes()
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if not LETTER.search(raw[a:b].decode()):
                    said[k], sure[k] = "und", 0.0
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(said, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(work, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
