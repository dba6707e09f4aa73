"""Hot keys and raw-record streams: a third of a batch on one key."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from mnemospark.operators import conversation as C
from mnemospark.operators import integrity as I
from mnemospark.schema import LONG_TERM_CHUNK_SECONDS
from mnemospark.session import work_dir
from mnemospark.sources.store import MessageStore
from mnemospark.streaming import jobs as J

D1 = dt.datetime(2025, 1, 1)
SCHEMA = ("trans_id long, timestamp timestamp, speaker string, text string, vec_id long, "
          "embedding_model string, embedding_dim int, embedding array<float>, index_type string, "
          "index_measurement string, seq long")


def batch(spark, n, hot):
    """n rows; the first `hot` share trans_id 1 at D1 (a hot primary key)."""
    df = spark.range(n).select(
        F.when(F.col("id") < hot, F.lit(1)).otherwise(F.col("id") + 10).alias("trans_id"),
        F.lit(D1).cast("timestamp").alias("timestamp"), F.lit("s").alias("speaker"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.lit(1).cast("long").alias("vec_id"),
        F.lit("m").alias("embedding_model"), F.lit(2).alias("embedding_dim"),
        F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float")).alias("embedding"),
        F.lit(None).cast("string").alias("index_type"), F.lit(None).cast("string").alias("index_measurement"),
        (F.col("id") + 1).alias("seq"))
    return df


def test_hot_primary_key(spark):
    n, hot = 3000, 1000
    acc, rej = I.check_batch(batch(spark, n, hot))
    assert acc.count() == n - hot + 1
    assert rej.groupBy("reject_reason").count().collect()[0]["count"] == hot - 1
    assert acc.filter(F.col("trans_id") == 1).first().seq == 1


def test_hot_unique_key(spark):
    n, hot = 3000, 1000
    b = batch(spark, n, 0).withColumn("text", F.when(F.col("seq") <= hot, F.lit("same")).otherwise(F.col("text")))
    acc, rej = I.check_batch(b)
    assert acc.count() == n - hot + 1
    assert {r.reject_reason for r in rej.collect()} == {"unique"}


def test_hot_thread_history(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 64)
    st = spark.range(3000).select(F.lit(1).cast("long").alias("thread_id"), F.col("id").alias("msg_id"),
                                  (F.lit(2999) - F.col("id")).alias("seq"), F.lit("u").alias("role"),
                                  F.col("id").cast("string").alias("text"))
    h = C.history_text(st).first()
    assert h.messages == 3000
    assert h.history.split("\n")[:3] == ["u: 2999", "u: 2998", "u: 2997"]


def test_json_stream_rejects_unknown_fields_and_embeds(spark):
    root = work_dir(spark, "t-json")
    os.makedirs(root + "/src", exist_ok=True)
    recs = [
        {"trans_id": 1, "timestamp": "2025-01-01T00:00:00Z", "speaker": "a", "text": "hello there", "vec_id": 1,
         "seq": 1},
        {"trans_id": 2, "timestamp": "2025-01-01T00:00:01Z", "speaker": "a", "text": "hi", "vec_id": 2,
         "timezone": "UTC", "seq": 2},
        {"trans_id": 3, "timestamp": "2025-01-01T00:00:02Z", "speaker": "bot", "text": "reply", "vec_id": 3,
         "seq": 3},
    ]
    with open(root + "/src/a.json", "w") as f:
        f.write("\n".join(json.dumps(r) for r in recs) + "\nnot json\n")
    src = spark.readStream.schema("value string").text(root + "/src")
    store = MessageStore(spark, root + "/store", LONG_TERM_CHUNK_SECONDS, "hash-64", 64)
    J.ingest_stream(src, store, root + "/dl", root + "/all", root + "/ck", "s", "bot",
                    json_col="value", embed=True).awaitTermination()
    stored = store.read().collect()
    assert [r.trans_id for r in stored] == [1] and len(stored[0].embedding) == 64
    reasons = sorted(r.reject_reason for r in spark.read.parquet(root + "/dl").collect())
    assert reasons[0] == "corrupt_record" and reasons[1] == "unknown_field:timezone"
