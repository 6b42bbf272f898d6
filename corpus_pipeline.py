"""A corpus pipeline: quality, near duplicates, repeated passages, personal data, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.

Cases: null and empty texts pass all stages but the classifier's, which may reject them; documents of which every word
repeats go; rows of one id fold in the second and third stage; rows without an id are never duplicates or repeats; an
empty table gives empty results; further columns pass through to the packed rows' input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, one_row_each, table, without_ids, written
from tidemark.llm.jaccard_join import jaccard_classes
from tidemark.llm.packing import pack_documents
from tidemark.llm.pii import replace_pii
from tidemark.llm.quality import score_quality
from tidemark.llm.substring_dedup import repeated_passages, without_passages


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return score_quality(docs, table(spark, sf_dir, "labels")).filter("keep").drop("quality_score", "keep")


def once(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows of one id fold into that with the least text; rows without an id stay."""
    with Scratch(spark, "pipeline-rows") as s:
        folded = one_row_each(s, docs, "doc_id", "text")
        return folded if folded is docs else s.finish(folded)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by five-word shingles at 0.8 or more, the one with the smallest id stays."""
    docs = once(spark, docs)
    classes = jaccard_classes(docs, k=5, percent=80)
    return without_ids(docs, classes.filter("doc_id <> component_id").select("doc_id"), "doc_id")


def repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that come before in a document with a smaller id are cut out."""
    docs = once(spark, docs)
    left = without_passages(docs, repeated_passages(docs))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates."""
    return replace_pii(docs).drop("n_entities").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's bucket, batch and place, by its number of words."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated", repeated), ("private", private), ("packed", packed)]

#: No SQL expresses the classifier, the surrogates or the boundaries; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
