"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``; they drop the documents (or, for lines, the text) that they reject.
Rows with null texts fail the quality rules, so no later stage sees them; repeated rows of a doc_id stay or go together, since
stages judge a document by its id or its text; among equal texts the smallest doc_id stays; a very long text is treated whole in every stage; an empty table
passes through as an empty table; extra columns, whatever their names, are carried along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontaminate, line_dedup, minhash, pieces, quality
from tideline.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first rules, without the lines that fail them."""
    return quality.keep_quality(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that at least three of them hold, but for the last one's."""
    cut = line_dedup.drop_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares five-word shingles at 0.8 or more."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces, n_pieces and the digest of the decoded text."""
    return pieces.encode(docs, pieces.Vocabulary.load())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]

#: Sampled segmentations have no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
