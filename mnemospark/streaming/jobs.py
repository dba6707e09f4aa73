"""Structured Streaming jobs.

* ``ingest_stream`` (T1, T4, S10-S12): file source -> per micro-batch
  F1, optional M1 embedding, P2, C1-C6 against the live store, then the
  accepted rows to the store, every F1-passing row to the all-records
  sink and the rejects to the dead letter.  Both side sinks are written
  to a path holding the batch id with overwrite, so a replayed batch
  rewrites instead of duplicating; the store append carries the batch id
  as ``ingest_id``, so a replay reaches the same decisions and stores
  only the rows a failed attempt did not (exactly once).
  Late rows are never dropped (no watermark).
* ``dedupe_stream`` (T2): duplicate suppression on the unique key against
  the stored keys of the batch's chunks, exact for rows of any age.
* ``thread_state_stream`` (T3): per-thread counters kept with
  ``applyInPandasWithState`` for the active threads (idle ones expire);
  ``thread_messages_stream`` keeps the messages themselves.
* ``chunk_count_stream`` (T5): rows per hour window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..operators import conversation as CV
from ..operators import embed as EM
from ..operators import integrity as I
from ..schema import LONG_TERM_CHUNK_SECONDS, UNIQUE_KEY
from ..session import materialize
from ..sources.store import MessageStore, chunk_of


#: A thread without messages for this long gives up its state (a day).
THREAD_IDLE_MS = 24 * 3600 * 1000


def _trigger(writer, available_now: bool, interval: str | None):
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=interval or "10 seconds")


#: Arrival numbers a micro-batch may use.
BATCH_SEQS = 1 << 40


def _numbered(rows: DataFrame, batch_id: int) -> DataFrame:
    """``seq``: dense numbers in arrival order (partition, then place),
    above those of every earlier batch.  Written once, so that the counts
    and the rows come from the same partitions."""
    placed = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), "stream-arrival")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
              .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    seq = F.lit(batch_id * BATCH_SEQS) + F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(before, "_part").withColumn("seq", seq).drop("_part", "_before", "_at")


def ingest_stream(source: DataFrame, store: MessageStore, dead_letter: str, all_records: str,
                  checkpoint: str, session_id: str, bot: str, model: str | None = None,
                  dim: int | None = None, available_now: bool = True,
                  interval: str | None = None, json_col: str | None = None,
                  embed: bool | None = None) -> StreamingQuery:
    """Continuous ingest of a streaming DataFrame of messages.  With
    ``json_col`` the source holds raw JSON records (C1 applies).  ``embed``:
    compute vectors for rows that have none (default: only when the
    source has no ``embedding`` column; a stored NULL vector is allowed)."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if json_col:
            batch = I.json_records(batch, json_col)
        rows = I.keep_messages(batch, bot)
        if "seq" not in rows.columns:
            rows = _numbered(rows, batch_id)
        # M1: embed the text of rows without a vector (by default only when
        # the source carries no vector column); P2: stamp what is missing.
        embed_rows = embed if embed is not None else "embedding" not in rows.columns
        model_, dim_ = model or f"hash-{EM.HASH_BUCKETS}", dim or EM.HASH_BUCKETS
        if "embedding" not in rows.columns:
            rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
        if embed_rows:
            need = rows.filter(F.col("embedding").isNull()).select("seq", "text")
            emb = EM.hash_embed(need, "seq", "text", out_col="_hash")
            rows = (rows.join(emb, "seq", "left")
                    .withColumn("embedding", F.coalesce("embedding", "_hash")).drop("_hash"))
        for c, v in (("embedding_model", F.lit(model_)), ("embedding_dim", F.lit(dim_).cast("int")),
                     ("index_type", F.lit(None).cast("string")), ("index_measurement", F.lit(None).cast("string"))):
            if c not in rows.columns:
                rows = rows.withColumn(c, v)
            elif embed_rows:
                rows = rows.withColumn(c, F.coalesce(F.col(c), v))
        # The batch is computed once, by the all-records write; the check reads that.
        kept = f"{all_records}/session_id={session_id}/batch_id={batch_id}"
        rows.withColumn("session_id", F.lit(session_id)).write.mode("overwrite").parquet(kept)
        rows = batch.sparkSession.read.schema(rows.schema).parquet(kept)
        extra = ({"unknown_col": "_unknown", "corrupt_col": "_corrupt"} if json_col else {})
        _, rejected = store.append(rows, session_id, ingest_id=f"{session_id}-b{batch_id}", written=True, **extra)
        rejected.write.mode("overwrite").parquet(f"{dead_letter}/batch_id={batch_id}")

    writer = source.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now, interval).start()


def dedupe_stream(source: DataFrame, sink: str, checkpoint: str, chunk_seconds: int = LONG_TERM_CHUNK_SECONDS,
                  order: Sequence[str] = ("trans_id",), available_now: bool = True) -> StreamingQuery:
    """Rows whose unique key was not seen before, however long ago.

    A micro-batch keeps one row of each key (the first by ``order``, then by
    the other columns; nulls first) and drops the keys that earlier batches
    wrote.  The key holds the time, so only the stored keys of the chunks that
    the batch touches are read.  No state is held and no watermark drops a
    late row.  A batch overwrites its own folder and does not look into it, so
    a repeated batch reaches the same rows.  Columns must be orderable (no
    maps), and none be named ``batch`` or ``chunk``.  ``deduped`` reads the
    sink."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        rest = [c for c in dict.fromkeys([*order, *columns]) if c not in UNIQUE_KEY]
        # A minimum is combined before the shuffle, so a hot key costs no task its size.
        first = batch.groupBy(*UNIQUE_KEY).agg(F.min(F.struct(*rest, F.lit(0).alias("_last"))).alias("_row"))
        chunk = F.coalesce(chunk_of("timestamp", chunk_seconds), F.lit(-1))
        rows = materialize(first.select(*[F.col(c) if c in UNIQUE_KEY else F.col(f"_row.{c}") for c in columns],
                                        chunk.alias("chunk")), "dedupe-batch")
        if batch_id > 0:
            fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in UNIQUE_KEY]
            stored = (spark.read.schema(", ".join([*fields, "batch long", "chunk long"])).parquet(sink)
                      .filter((F.col("batch") < batch_id) & I.chunks_of(rows))
                      .select(*[F.col(c).alias(f"_{c}") for c in UNIQUE_KEY]))
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in UNIQUE_KEY]
            rows = rows.join(stored, reduce(and_, same), "left_anti")
        rows.write.mode("overwrite").partitionBy("chunk").parquet(f"{sink}/batch={batch_id}")

    writer = source.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now, None).start()


def deduped(spark, sink: str, schema: StructType) -> DataFrame:
    """The rows that ``dedupe_stream`` kept, with the columns of ``schema``."""
    return spark.read.schema(schema).parquet(sink)


THREAD_OUT = "thread_id long, since_ms long, messages long, last_turn long, chars long"
THREAD_STATE = "since_ms long, messages long, last_turn long, chars long"


def _thread_update(idle_ms: int):
    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the sink has its last counts
            state.remove()
            return
        since, n, last, chars = state.get if state.exists else (state.getCurrentProcessingTimeMs(), 0, None, 0)
        for pdf in frames:
            n += len(pdf)
            turn = pdf["turn"].max()  # of the turns that are known
            if not pd.isna(turn):
                last = int(turn) if last is None else max(last, int(turn))
            chars += int(pdf["text"].fillna("").str.len().sum())
        state.update((since, n, last, chars))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"thread_id": [key[0]], "since_ms": [since], "messages": [n],
                            "last_turn": pd.array([last], dtype="Int64"), "chars": [chars]})
    return update


def thread_state_stream(source: DataFrame, sink: str, checkpoint: str, available_now: bool = True,
                        idle_ms: int = THREAD_IDLE_MS) -> StreamingQuery:
    """Running per-thread counters; each trigger writes the threads it
    updated.  The state of a thread without messages for ``idle_ms`` is
    removed; when it returns, a new span of counts starts (``since_ms``, the
    time of its first trigger).  ``latest_thread_state`` adds the spans up, so
    the counts stay exact while the state holds the active threads only.
    Checkpoints and sinks of unbounded state cannot be continued."""
    states = (source.select(F.col("conv_id").alias("thread_id"), "turn", "text")
              .groupBy("thread_id")
              .applyInPandasWithState(_thread_update(idle_ms), THREAD_OUT, THREAD_STATE, "update",
                                      GroupStateTimeout.ProcessingTimeTimeout))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite") \
            .parquet(f"{sink}/batch={batch_id}")

    writer = (states.writeStream.outputMode("update").foreachBatch(per_batch)
              .option("checkpointLocation", checkpoint))
    if not available_now:
        return _trigger(writer, False, None).start()
    # Spark runs batches without data for as long as there are timeouts, so an
    # availableNow run would not end; there, states expire in batches with data.
    conf, name = source.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return _trigger(writer, True, None).start()  # the query copies the settings
    finally:
        conf.set(name, before)


def thread_messages_stream(source: DataFrame, sink: str, checkpoint: str,
                           available_now: bool = True) -> StreamingQuery:
    """T3, the messages: each trigger writes its rows (``thread_id, msg_id,
    seq, role, text``) under its batch id, so a repeated batch rewrites
    itself and no state is held.  ``thread_messages`` reads them."""
    rows = source.select("thread_id", "msg_id", "seq", "role", "text")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    writer = rows.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now, None).start()


def thread_messages(spark, sink: str) -> DataFrame:
    """The messages of each thread in order; a message id seen again has its
    newest text (M2)."""
    return CV.history_rows(CV.upsert(spark.read.parquet(sink).drop("batch")))


def chunk_count_stream(source: DataFrame, sink: str, checkpoint: str, window: str = "1 hour",
                       available_now: bool = True) -> StreamingQuery:
    """T5: rows per time window as they arrive.  Each trigger writes its own
    rows' counts under its batch id, so a repeated batch rewrites itself, no
    state is held and no late row is lost; ``latest_chunk_counts`` adds them
    up.  Sinks and checkpoints of running totals cannot be continued."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.groupBy(F.window("timestamp", window).alias("w")).agg(F.count(F.lit(1)).alias("rows"))
         .select(F.col("w.start").alias("window_start"), "rows")
         .write.mode("overwrite").parquet(f"{sink}/batch={batch_id}"))

    writer = source.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now, None).start()


def latest_chunk_counts(spark, sink: str) -> DataFrame:
    """Current rows per window: the sum over the batches."""
    return spark.read.parquet(sink).groupBy("window_start").agg(F.sum("rows").alias("rows"))


def latest_thread_state(spark, sink: str) -> DataFrame:
    """Current per-thread counts from the update log: the newest batch of
    each span, then the sum over a thread's spans."""
    spans = (spark.read.parquet(sink).groupBy("thread_id", "since_ms")
             .agg(F.max_by(F.struct("messages", "last_turn", "chars"), "batch_id").alias("s")))
    return (spans.groupBy("thread_id")
            .agg(F.sum("s.messages").alias("messages"), F.max("s.last_turn").alias("last_turn"),
                 F.sum("s.chars").alias("chars")))
