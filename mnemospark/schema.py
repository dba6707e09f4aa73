"""Fixed schemas of the message store, the normalised pair and rejects."""

from __future__ import annotations

from pyspark.sql import types as T

STORE_COLUMNS = [
    T.StructField("trans_id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("speaker", T.StringType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("vec_id", T.LongType(), False),
    T.StructField("embedding_model", T.StringType(), False),
    T.StructField("embedding_dim", T.IntegerType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType(), containsNull=False), True),
    T.StructField("index_type", T.StringType(), True),
    T.StructField("index_measurement", T.StringType(), True),
]
STORE_SCHEMA = T.StructType(STORE_COLUMNS)
STORE_FIELDS = [f.name for f in STORE_COLUMNS]

# Columns the store adds: arrival order, session, time chunk, sign signature.
EXTRA_COLUMNS = [
    T.StructField("seq", T.LongType(), False),
    T.StructField("session_id", T.StringType(), False),
    T.StructField("chunk", T.LongType(), False),
    T.StructField("sig", T.ArrayType(T.LongType(), containsNull=False), True),
    T.StructField("text_sha256", T.BinaryType(), True),
    T.StructField("ingest_id", T.StringType(), True),
]
STORED_SCHEMA = T.StructType(STORE_COLUMNS + EXTRA_COLUMNS)

# NOT NULL columns (C2), in declaration order.
REQUIRED = ["trans_id", "timestamp", "speaker", "text", "vec_id",
            "embedding_model", "embedding_dim"]

PRIMARY_KEY = ["trans_id", "timestamp"]
UNIQUE_KEY = ["timestamp", "speaker", "text"]

# Time chunks of one hour for the short-term store and
# 365 days for the long-term store.
SHORT_TERM_CHUNK_SECONDS = 3600
LONG_TERM_CHUNK_SECONDS = 365 * 24 * 3600

# The CSV form keeps the ten store columns, embedding as "[a, b, ...]" text.
CSV_SCHEMA = T.StructType(
    [T.StructField(f.name, T.StringType() if f.name == "embedding" else f.dataType, True)
     for f in STORE_COLUMNS]
    + [T.StructField("_corrupt", T.StringType(), True)]
)

# Normalised pair (transcriptions 1:1 vectors).
TRANSCRIPTIONS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("speaker", T.StringType(), False),
    T.StructField("text", T.StringType(), False),
])
VECTORS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("embedding_model", T.StringType(), False),
    T.StructField("embedding_dim", T.IntegerType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType(), containsNull=False), True),
    T.StructField("index_type", T.StringType(), True),
    T.StructField("index_measurement", T.StringType(), True),
    T.StructField("transcription_id", T.LongType(), False),
])

# Conversation state rows.
CONVERSATION_SCHEMA = T.StructType([
    T.StructField("thread_id", T.LongType(), False),
    T.StructField("msg_id", T.LongType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("role", T.StringType(), False),
    T.StructField("text", T.StringType(), True),
])
