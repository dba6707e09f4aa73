"""Registered streaming queries.

Each query writes its input as files in arrival order (one append per
arrival level, so file times follow the order), runs the stream with an
``availableNow`` trigger over several micro-batches and returns what the
sink holds.  The oracle is the batch form of the same result.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conversation as C
from ..schema import SHORT_TERM_CHUNK_SECONDS
from ..session import materialize, work_dir
from ..sources.store import MessageStore
from ..sources.tables import as_ntz, messages, table
from ..streaming import jobs as J
from .common import SQL_MESSAGES_CTE
from .q_ingest import _SQL_BATCH, BOT, DIM, MODEL, REPLAY, fault_batch
from .registry import register

FILES_PER_LEVEL = 4


def _write_levels(df: DataFrame, level: F.Column, levels: list[int], path: str) -> int:
    """Write ``df`` split by arrival level, each level as FILES_PER_LEVEL
    files whose times are later than those of the level before: the file
    source reads files in the order of their times.  Returns the files per
    level."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    start, dated = int(time.time()) - 10 * len(levels), set()
    for i, lv in enumerate(levels):
        df.filter(level == lv).repartition(FILES_PER_LEVEL).write.mode("append").parquet(path)
        for status in fs.listStatus(folder):
            if status.getPath().getName() not in dated:
                dated.add(status.getPath().getName())
                fs.setTimes(status.getPath(), (start + 10 * i) * 1000, -1)
    return FILES_PER_LEVEL


def _source(spark: SparkSession, path: str, schema, files_per_trigger: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


_SINK_COLUMNS = ["seq", "trans_id", "timestamp", "speaker", "text", "vec_id", "embedding_model", "embedding_dim"]


@register("stream_ingest", ("T1", "T4", "S9", "S10", "S11", "S12"), f"""
with {_SQL_BATCH}
select 'store' as sink, seq, trans_id, timestamp, speaker, text, vec_id, embedding_model, embedding_dim,
       len(embedding) as emb_len, null as reason from accepted
union all
select 'all_records', seq, trans_id, timestamp, speaker, text, vec_id, embedding_model, embedding_dim,
       len(embedding), null from batch
union all
select 'dead_letter', seq, trans_id, timestamp, speaker, text, vec_id, embedding_model, embedding_dim,
       len(embedding), reject_reason from rejected
""")
def stream_ingest(spark, sf_dir):
    """What the store, the all-records sink and the dead letter hold after
    the stream.  A clash with an earlier micro-batch is one with the store;
    the reasons are compared without that difference."""
    root = work_dir(spark, "stream-ingest")
    src = materialize(fault_batch(spark, sf_dir), "stream-ingest-input")  # computed once, cut into levels
    store = MessageStore(spark, f"{root}/store", SHORT_TERM_CHUNK_SECONDS, MODEL, DIM)
    for level in range(4):  # a level arrives; the stream goes on from its checkpoint
        src.filter(F.floor(F.col("seq") / REPLAY) == level).write.mode("append").parquet(f"{root}/src")
        source = spark.readStream.schema(src.schema).parquet(f"{root}/src")
        J.ingest_stream(source, store, f"{root}/dead_letter", f"{root}/all_records", f"{root}/_checkpoint",
                        "s0", BOT).awaitTermination()
    none = F.lit(None).cast("string")
    sinks = [("store", store.read(), none), ("all_records", spark.read.parquet(f"{root}/all_records"), none),
             ("dead_letter", spark.read.parquet(f"{root}/dead_letter"),
              F.regexp_replace("reject_reason", "_stored$", ""))]
    out = None
    for name, rows, reason in sinks:
        part = rows.select(F.lit(name).alias("sink"), *_SINK_COLUMNS,
                           F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("emb_len"),
                           reason.alias("reason"))
        out = part if out is None else out.unionByName(part)
    return as_ntz(out)


@register("stream_dedupe", "T2", f"""
with {SQL_MESSAGES_CTE}
select trans_id, timestamp, speaker from messages
""")
def stream_dedupe(spark, sf_dir):
    """The last twenty days come first, the others late, then replays of old
    and new rows under other ids: every message stays once."""
    root = work_dir(spark, "stream-dedupe")
    m = messages(spark, sf_dir, extra=("event_type",))
    replays = m.filter(F.col("event_type") == "error").withColumn("trans_id", -1 - F.col("trans_id"))
    late = F.when(F.dayofmonth("timestamp") > 10, 0).otherwise(1)
    src = (m.withColumn("_lv", late).unionByName(replays.withColumn("_lv", F.lit(2)))
           .drop("event_type", "embedding"))
    n = _write_levels(src, F.col("_lv"), [0, 1, 2], f"{root}/src")
    schema = spark.read.parquet(f"{root}/src").schema
    q = J.dedupe_stream(_source(spark, f"{root}/src", schema, n), f"{root}/out", f"{root}/_checkpoint",
                        chunk_seconds=24 * 3600)
    q.awaitTermination()
    return as_ntz(J.deduped(spark, f"{root}/out", schema).select("trans_id", "timestamp", "speaker"))


@register("stream_threads", "T3", """
select conv_id as thread_id, count(*) as messages, max(turn) as last_turn,
       cast(sum(length(coalesce(text, ''))) as bigint) as chars
from conversations group by conv_id
""")
def stream_threads(spark, sf_dir):
    root = work_dir(spark, "stream-threads")
    c = table(spark, sf_dir, "conversations")
    level = F.when(F.col("turn") < 2, 0).when(F.col("turn") < 4, 1).otherwise(2)
    n = _write_levels(c, level, [0, 1, 2], f"{root}/src")
    schema = spark.read.parquet(f"{root}/src").schema
    q = J.thread_state_stream(_source(spark, f"{root}/src", schema, n), f"{root}/out", f"{root}/_checkpoint")
    q.awaitTermination()
    return J.latest_thread_state(spark, f"{root}/out")


@register("stream_messages", ("T3", "A6", "M2"), """
select conv_id as thread_id, row_number() over (partition by conv_id order by turn) as position, turn as msg_id,
       role, text from conversations
""")
def stream_messages(spark, sf_dir):
    root = work_dir(spark, "stream-messages")
    c = C.from_turns(table(spark, sf_dir, "conversations"))
    again = c.filter("msg_id = 0").withColumn("text", F.lit("first draft"))  # replaced by the later level
    level = F.when(F.col("msg_id") == 0, 2).when(F.col("msg_id") < 3, 1).otherwise(2)
    rows = c.withColumn("_lv", level).unionByName(again.withColumn("_lv", F.lit(0)).withColumn("seq", F.lit(-1).cast("long")))
    n = _write_levels(rows, F.col("_lv"), [0, 1, 2], f"{root}/src")
    schema = spark.read.parquet(f"{root}/src").schema
    for _ in range(2):  # the second run starts from the checkpoint and adds nothing
        J.thread_messages_stream(_source(spark, f"{root}/src", schema, n), f"{root}/out",
                                 f"{root}/_checkpoint").awaitTermination()
    return J.thread_messages(spark, f"{root}/out")


@register("stream_chunks", ("T5", "S14"), f"""
with {SQL_MESSAGES_CTE}
select date_trunc('hour', timestamp) as window_start, count(*) as rows from messages group by 1
""")
def stream_chunks(spark, sf_dir):
    root = work_dir(spark, "stream-chunks")
    m = messages(spark, sf_dir).select("trans_id", "timestamp", "speaker")
    day = F.dayofmonth("timestamp")
    level = F.when(day <= 10, 0).when(day <= 20, 1).otherwise(2)
    n = _write_levels(m, level, [0, 1, 2], f"{root}/src")
    schema = spark.read.parquet(f"{root}/src").schema
    q = J.chunk_count_stream(_source(spark, f"{root}/src", schema, n), f"{root}/out", f"{root}/_checkpoint")
    q.awaitTermination()
    return as_ntz(J.latest_chunk_counts(spark, f"{root}/out"))
