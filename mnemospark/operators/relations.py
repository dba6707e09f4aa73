"""The normalised pair ``transcriptions 1:1 vectors``.

``vectors.transcription_id`` references ``transcriptions.id``.  All
checks are joins or aggregates; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTOR_COLS = ["embedding_model", "embedding_dim", "embedding", "index_type", "index_measurement"]


def split(combined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Combined message rows to ``(transcriptions, vectors)``.  The
    vector row takes the message id as its own id and keeps ``vec_id``."""
    t = combined.select(F.col("trans_id").alias("id"), "timestamp", "speaker", "text")
    v = combined.select(F.col("trans_id").alias("id"), "vec_id", *VECTOR_COLS,
                        F.col("trans_id").alias("transcription_id"))
    return t, v


def compose(transcriptions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Inner equi-join back to the combined form."""
    v = vectors.drop("id")
    return (transcriptions.join(v, transcriptions["id"] == v["transcription_id"], "inner")
            .select(F.col("id").alias("trans_id"), "timestamp", "speaker", "text", "vec_id", *VECTOR_COLS))


def orphans(vectors: DataFrame, transcriptions: DataFrame) -> DataFrame:
    """Vectors whose transcription does not exist."""
    return vectors.join(transcriptions.select(F.col("id").alias("transcription_id")),
                        "transcription_id", "left_anti")


def cascade_delete(transcriptions: DataFrame, vectors: DataFrame, doomed) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete the transcriptions matching ``doomed`` and, by cascade,
    their vectors; delete-orphan also removes vectors without a parent.
    Returns ``(kept transcriptions, kept vectors, deleted vectors with reason)``."""
    kept_t = transcriptions.filter(~doomed)
    gone_t = transcriptions.filter(doomed).select(F.col("id").alias("transcription_id"))
    all_t = transcriptions.select(F.col("id").alias("transcription_id"))
    cascade = vectors.join(gone_t, "transcription_id", "left_semi").withColumn("reason", F.lit("cascade"))
    orphan = vectors.join(all_t, "transcription_id", "left_anti").withColumn("reason", F.lit("orphan"))
    kept_v = vectors.join(kept_t.select(F.col("id").alias("transcription_id")), "transcription_id", "left_semi")
    return kept_t, kept_v, cascade.unionByName(orphan)


def one_to_one_violations(vectors: DataFrame) -> DataFrame:
    """Transcriptions referenced by more than one vector."""
    return (vectors.groupBy("transcription_id").agg(F.count(F.lit(1)).alias("vectors"))
            .filter(F.col("vectors") > 1))
