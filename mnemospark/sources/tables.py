"""Input tables and the views derived from them.

Every reader selects its columns explicitly so the parquet scan only
reads what the plan uses (``ReadSchema`` in ``explain``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; expected one of {list(TABLES)}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Chat messages with embeddings, derived from events, embeddings and
    benchmark: ``trans_id, timestamp, speaker, text, vec_id, embedding``.

    ``timestamp`` is a UTC instant (the NTZ event time read as UTC).  An
    event takes the vector and the text whose id is its own id modulo the
    number of vectors and texts, so every one of them is used.  The counts
    come from the files' metadata; Spark picks each join by the sides' sizes.
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", *extra)
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    n_vectors, n_texts = max(v.count(), 1), max(b.count(), 1)
    return (
        e.join(v, v.vec_id == F.col("event_id") % n_vectors)
        .join(b, b.item_id == F.col("event_id") % n_texts)
        .select(
            F.col("event_id").alias("trans_id"),
            F.col("ts").cast("timestamp").alias("timestamp"),
            F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("speaker"),
            F.col("text"),
            F.col("vec_id"),
            F.col("embedding"),
            *extra,
        )
    )


MESSAGES_SQL = """
select e.event_id as trans_id, e.ts as timestamp,
       concat('user_', cast(e.user_id as varchar)) as speaker,
       b.text, v.vec_id, v.embedding
from events e
join embeddings v on v.vec_id  = e.event_id % (select count(*) from embeddings)
join benchmark  b on b.item_id = e.event_id % (select count(*) from benchmark)
"""


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of exported files derived from ``documents``:
    ``doc_id, source, path`` with names like ``web_2024-01-03_17.csv``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.select(
        "doc_id", "source",
        F.concat(F.col("source"), F.lit("_2024-01-0"), (F.col("doc_id") % 9 + 1).cast("string"),
                 F.lit("_"), F.col("doc_id").cast("string"), F.lit(".csv")).alias("path"),
    )


FILE_LISTING_SQL = """
select doc_id, source,
       concat(source, '_', '2024-01-0', cast(doc_id % 9 + 1 as varchar), '_', cast(doc_id as varchar), '.csv') as path
from documents
"""


def as_ntz(df: DataFrame) -> DataFrame:
    """Cast UTC timestamp columns to NTZ for output (session zone is UTC,
    so the wall-clock value is unchanged)."""
    from pyspark.sql.types import TimestampType
    cols = [F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, TimestampType)
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)
