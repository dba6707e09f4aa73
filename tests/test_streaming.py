"""Streaming equals batch, and a restart from the checkpoint adds nothing."""

from pyspark.sql import functions as F

from mnemospark.operators import integrity as I
from mnemospark.plans.q_ingest import BOT, DIM, MODEL, REPLAY, fault_batch
from mnemospark.plans.q_stream import _source, _write_levels
from mnemospark.schema import LONG_TERM_CHUNK_SECONDS
from mnemospark.session import work_dir
from mnemospark.sources.store import MessageStore
from mnemospark.streaming import jobs as J
from tests.conftest import SF_SMALL


def test_ingest_stream_restart_adds_nothing(spark):
    from mnemospark.operators import integrity as I
    root = work_dir(spark, "t-stream")
    src = fault_batch(spark, SF_SMALL)
    n = _write_levels(src, F.floor(F.col("seq") / REPLAY), [0, 1, 2, 3], f"{root}/src")
    schema = spark.read.parquet(f"{root}/src").schema
    store = MessageStore(spark, f"{root}/store", LONG_TERM_CHUNK_SECONDS, MODEL, DIM)
    args = (store, f"{root}/dl", f"{root}/all", f"{root}/ck", "s0", BOT)
    J.ingest_stream(_source(spark, f"{root}/src", schema, n), *args).awaitTermination()
    first = store.read().count()
    acc, rej = I.check_batch(src)
    assert first == acc.count()
    # every row passing F1 is in the all-records sink; rejects in the dead letter
    assert spark.read.parquet(f"{root}/all").count() == src.count()
    assert spark.read.parquet(f"{root}/dl").count() == rej.count()
    J.ingest_stream(_source(spark, f"{root}/src", schema, n), *args).awaitTermination()
    assert store.read().count() == first


def test_thread_state_matches_batch(spark):
    from mnemospark.sources.tables import table
    root = work_dir(spark, "t-threads")
    c = table(spark, SF_SMALL, "conversations")
    n = _write_levels(c, F.when(F.col("turn") < 3, 0).otherwise(1), [0, 1], f"{root}/src")
    schema = spark.read.parquet(f"{root}/src").schema
    J.thread_state_stream(_source(spark, f"{root}/src", schema, n), f"{root}/out", f"{root}/ck").awaitTermination()
    got = {r.thread_id: (r.messages, r.last_turn) for r in J.latest_thread_state(spark, f"{root}/out").collect()}
    want = {r.conv_id: (r.n, r.m) for r in c.groupBy("conv_id").agg(F.count("*").alias("n"),
                                                                     F.max("turn").alias("m")).collect()}
    assert got == want


def test_chunk_counts_keep_rows_that_come_months_late(spark):
    root = work_dir(spark, "t-chunks")
    rows = [(0, "2024-06-01 00:10:00"), (0, "2024-01-05 07:00:00"), (1, "2024-01-20 07:05:00"),
            (1, "2024-01-05 07:30:00"), (2, "2024-01-20 07:59:59"), (2, "2024-06-01 00:20:00")]
    df = spark.createDataFrame(rows, "lv int, t string").withColumn("timestamp", F.to_timestamp("t"))
    n = _write_levels(df, F.col("lv"), [0, 1, 2], f"{root}/src")
    schema = spark.read.parquet(f"{root}/src").schema
    for _ in range(2):  # the second run starts from the checkpoint and adds nothing
        J.chunk_count_stream(_source(spark, f"{root}/src", schema, n), f"{root}/out", f"{root}/ck").awaitTermination()
    got = J.latest_chunk_counts(spark, f"{root}/out").select(F.date_format("window_start", "MM-dd HH"), "rows")
    assert {tuple(r) for r in got.collect()} == {("06-01 00", 2), ("01-05 07", 2), ("01-20 07", 2)}


def test_arrival_numbers_are_dense_at_any_partition_count(spark):
    rows = spark.range(1000).repartition(300)
    got = [r["seq"] for r in J._numbered(rows, 3).collect()]
    assert sorted(got) == [3 * J.BATCH_SEQS + i for i in range(1000)]


def _files(spark, rows, schema, root, level):
    """One batch: ``rows`` as a single file after those already there."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/src")
    return spark.readStream.schema(schema).parquet(f"{root}/src")


def test_dedupe_keeps_late_new_rows_and_drops_late_repeats(spark):
    root, schema = work_dir(spark, "t-dedupe"), "trans_id long, timestamp timestamp, speaker string, text string, v array<float>"
    day = lambda s: None if s is None else __import__("datetime").datetime.fromisoformat(s)
    batches = [
        [(1, "2024-06-01", "a", "x", [1.0]), (2, "2024-06-01", "a", "x", [2.0]), (3, None, "a", "x", None), (4, "2024-06-01", None, "x", None)],
        [(5, "2020-01-01", "a", "late and new", None), (6, "2024-06-01", "a", "x", None), (7, None, "a", "x", None), (8, "2024-06-01", None, "x", None)],
        [(9, "2020-01-01", "a", "late and new", None), (10, "2024-06-01", "a", "X", None), (11, "2024-06-01", "a", "X", None)],
        [],
    ]
    kept = []
    for i, b in enumerate(batches):
        src = _files(spark, [(r[0], day(r[1]), *r[2:]) for r in b], schema, root, i)
        for _ in range(2):  # the second run adds nothing
            J.dedupe_stream(src, f"{root}/out", f"{root}/ck").awaitTermination()
        kept.append(sorted(r["trans_id"] for r in J.deduped(spark, f"{root}/out", spark.read.parquet(f"{root}/src").schema).collect()))
    assert kept == [[1, 3, 4], [1, 3, 4, 5], [1, 3, 4, 5, 10], [1, 3, 4, 5, 10]]


def test_dedupe_reads_only_the_chunks_of_the_batch(spark, monkeypatch):
    root, schema, seen = work_dir(spark, "t-dedupe-plan"), "trans_id long, timestamp timestamp, speaker string, text string", []
    import datetime as dt
    real = J.I.chunks_of
    monkeypatch.setattr(J.I, "chunks_of", lambda rows: seen.append(str(real(rows))) or real(rows))
    for i, d in enumerate([dt.datetime(2024, 6, 1), dt.datetime(2024, 6, 2)]):
        src = _files(spark, [(i, d, "a", "x")], schema, root, i)
        J.dedupe_stream(src, f"{root}/out", f"{root}/ck", chunk_seconds=24 * 3600).awaitTermination()
    assert len(seen) == 1 and str(int(dt.datetime(2024, 6, 2).timestamp()) // 86400) in seen[0]


def test_idle_thread_gives_up_its_state_and_returns_exactly(spark):
    import time
    root, schema = work_dir(spark, "t-expire"), "conv_id long, turn long, text string"

    def run(i, rows):
        src = _files(spark, rows, schema, root, i)
        q = J.thread_state_stream(src, f"{root}/out", f"{root}/ck", idle_ms=1000)
        q.awaitTermination()
        return sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"])
    run(0, [(1, 0, "ab"), (1, 1, None), (3, None, "z")])
    time.sleep(1.5)
    held = run(1, [(2, 0, "c")])
    assert held == 1  # threads 1 and 3 are gone from the state
    run(2, [(1, 2, "def"), (2, 1, "")])
    got = {tuple(r) for r in J.latest_thread_state(spark, f"{root}/out").collect()}
    assert got == {(1, 3, 2, 5), (2, 2, 1, 1), (3, 1, None, 1)}
    spans = spark.read.parquet(f"{root}/out").filter("thread_id = 1").select("since_ms").distinct().count()
    assert spans == 2


def test_ingest_stream_writes_a_batch_once_before_the_check(spark, monkeypatch):
    """The check reads the rows that the all-records sink holds."""
    root = work_dir(spark, "t-stream-once")
    rows = spark.range(30).select(
        F.col("id").alias("trans_id"), F.expr("timestamp'2024-01-10' + make_dt_interval(cast(id % 9 as int))").alias("timestamp"),
        F.when(F.col("id") != 3, F.lit("u")).alias("speaker"), F.concat(F.lit("text "), "id").alias("text"),
        F.col("id").alias("vec_id"), F.lit(MODEL).alias("embedding_model"), F.lit(DIM).alias("embedding_dim"),
        F.transform(F.sequence(F.lit(1), F.lit(DIM)), lambda x: (x + F.col("id")).cast("float")).alias("embedding"), F.col("id").alias("seq"))
    names, plain = [], I.materialize
    monkeypatch.setattr(I, "materialize", lambda df, name: names.append(name) or plain(df, name))
    store = MessageStore(spark, f"{root}/store", 3600, MODEL, DIM)
    for part in ("seq % 3 > 0", "seq % 3 = 0"):  # the second run goes on from the checkpoint
        rows.filter(part).write.mode("append").parquet(f"{root}/src")
        source = spark.readStream.schema(rows.schema).parquet(f"{root}/src")
        J.ingest_stream(source, store, f"{root}/dead", f"{root}/all", f"{root}/_checkpoint", "s0", BOT).awaitTermination()
    assert "checked" not in names and names.count("batch-keys") == 2
    assert sorted(r["trans_id"] for r in store.read().collect()) == [i for i in range(30) if i != 3]
    dead = spark.read.parquet(f"{root}/dead").select("trans_id", "reject_reason").collect()
    assert [tuple(r) for r in dead] == [(3, "null:speaker")]
    assert spark.read.parquet(f"{root}/all").count() == 30
