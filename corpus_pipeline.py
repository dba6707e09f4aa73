"""The corpus pipeline: quality, line dedup, near duplicates, benchmark
decontamination and packing, each over all that the stage before it kept.

A stage takes ``(spark, docs, sf_dir)``; all but the last return the columns
of ``documents``.  ``run`` writes what a stage returns as Parquet in the
session's shared folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import decontaminate, line_dedup, packing, quality, simhash
from mnemospark.llm.base import DOCUMENT_COLUMNS, documents, materialize
from mnemospark.llm.queries import tokenizer_path

#: The fit's labelled rows, the wanted grade and its least probability.
WANTED_GRADE, LEAST_PROBABILITY = 2, 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is good and not toxic, more likely than not."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, quality.grades_of_labels(labels))
    return quality.select_quality(docs, model, WANTED_GRADE, LEAST_PROBABILITY).select(*DOCUMENT_COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go; a document that loses all goes too."""
    got = line_dedup.dedup_lines(docs)
    left = (F.col("n_removed") == 0) | (F.trim("kept_text") != "")
    return (got.filter(left)
            .withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars"))
                        .otherwise(F.length("kept_text").cast("long")))
            .withColumn("text", F.col("kept_text")).select(*DOCUMENT_COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_one(docs).select(*DOCUMENT_COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, items).select(*DOCUMENT_COLUMNS)


def vector_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("vector_packing", vector_packing),
]

#: A fitted model, component search and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
