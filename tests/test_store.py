"""Store writes, snapshot/reset, CSV round trip, relations."""

import os

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import integrity as I
from mnemospark.operators import relations as R
from mnemospark.schema import LONG_TERM_CHUNK_SECONDS
from mnemospark.session import work_dir
from mnemospark.sources import csv_io
from mnemospark.sources import store as ST
from mnemospark.sources.tables import messages
from tests.conftest import SF_SMALL


def stamped(spark):
    return I.stamp_provenance(messages(spark, SF_SMALL), "m", 64).withColumn("seq", F.col("trans_id"))


def test_append_twice_adds_nothing(spark):
    st = ST.MessageStore(spark, work_dir(spark, "t-store"), LONG_TERM_CHUNK_SECONDS)
    rows = stamped(spark)
    acc, rej = st.append(rows, "s1")
    n = rows.count()
    assert acc.count() == n and rej.count() == 0
    acc2, rej2 = st.append(rows, "s1")
    assert acc2.count() == 0 and rej2.count() == n
    assert st.read().count() == n
    with pytest.raises(ValueError):
        st.append(rows, "s1", strict=True)


def test_write_modes(spark):
    path = work_dir(spark, "t-modes")
    rows = ST.prepare(stamped(spark), "s", LONG_TERM_CHUNK_SECONDS)
    ST.write_rows(rows, path, "errorifexists")
    with pytest.raises(Exception):
        ST.write_rows(rows, path, "errorifexists")
    ST.write_rows(rows, path, "append")
    assert spark.read.parquet(path).count() == 2 * rows.count()
    ST.write_rows(rows, path, "overwrite")
    assert spark.read.parquet(path).count() == rows.count()
    with pytest.raises(ValueError):
        ST.write_rows(rows, path, "upsert")


def test_snapshot_and_reset(spark):
    root = work_dir(spark, "t-reset")
    st = ST.MessageStore(spark, root, LONG_TERM_CHUNK_SECONDS)
    rows = stamped(spark)
    st.append(rows, "a")
    with pytest.raises(Exception):
        st.reset(F.lit(False), root + "_missing")
    man = st.snapshot(root + "_snap")
    assert man["rows"] == rows.count()
    assert ST.manifest(spark.read.parquet(root + "_snap")) == ST.manifest(st.read())
    st.append(rows.withColumn("trans_id", F.col("trans_id") + 10**6)
              .withColumn("text", F.concat(F.lit("new "), F.col("text"))), "b")
    with pytest.raises(ValueError, match="does not match"):
        st.reset(F.col("session_id") != "b", root + "_snap")
    st.snapshot(root + "_snap2")
    v = st.reset(F.col("session_id") != "b", root + "_snap2")
    assert v == 1 and st.read().count() == rows.count()
    assert {r.session_id for r in st.read().select("session_id").distinct().collect()} == {"a"}


def test_csv_roundtrip_with_quotes_and_corrupt(spark):
    path = work_dir(spark, "t-csv")
    rows = stamped(spark).limit(20).withColumn("text", F.concat(F.col("text"), F.lit(' "q", \nline')))
    csv_io.write_csv(rows, path + "/a", mode="errorifexists")
    back = csv_io.read_csv(spark, path + "/a")
    assert back.filter(F.col("_corrupt").isNotNull()).count() == 0
    a = {r.trans_id: (r.text, r.embedding) for r in rows.collect()}
    b = {r.trans_id: (r.text, r.embedding) for r in back.collect()}
    assert a == b
    os.makedirs(path + "/bad", exist_ok=True)
    with open(path + "/bad/x.csv", "w") as f:
        f.write("trans_id,timestamp,speaker,text,vec_id,embedding_model,embedding_dim,embedding,"
                "index_type,index_measurement\n")
        f.write("1,2024-01-01T00:00:00.000000Z,s,t,1,m,2,\"[1, x]\",,\n")
        f.write("notanumber,2024-01-01T00:00:00.000000Z,s,t,1,m,2,\"[1, 2]\",,\n")
    bad = csv_io.read_csv(spark, path + "/bad").collect()
    assert all(r._corrupt is not None for r in bad)
    checked = I.row_checks(csv_io.read_csv(spark, path + "/bad"), corrupt_col="_corrupt").collect()
    assert {r.reject_reason for r in checked} == {"corrupt_record"}


def test_relations_round_trip(spark):
    rows = I.stamp_provenance(messages(spark, SF_SMALL), "m", 64)
    t, v = R.split(rows)
    back = R.compose(t, v)
    cols = ["trans_id", "timestamp", "speaker", "text", "vec_id", "embedding_model", "embedding_dim", "embedding"]
    assert back.select(*cols).exceptAll(rows.select(*cols)).count() == 0
    assert rows.select(*cols).exceptAll(back.select(*cols)).count() == 0
    assert R.orphans(v, t).count() == 0
    assert R.one_to_one_violations(v).count() == 0
    kept_t, kept_v, deleted = R.cascade_delete(t, v, F.col("speaker") == "user_1")
    n_del = t.filter(F.col("speaker") == "user_1").count()
    assert deleted.count() == n_del and kept_v.count() == v.count() - n_del


def test_user_writer_hook(spark):
    seen = []

    def hook(df, path, mode):
        seen.append(df.count())
        ST.write_rows(df, path, mode)

    st = ST.MessageStore(spark, work_dir(spark, "t-hook"), LONG_TERM_CHUNK_SECONDS)
    st.append(stamped(spark), "s", writer=hook)
    assert seen == [stamped(spark).count()] and st.read().count() == seen[0]


def test_compressed_input_by_extension(spark):
    import bz2
    import gzip
    path = work_dir(spark, "t-codec")
    os.makedirs(path, exist_ok=True)
    head = ("trans_id,timestamp,speaker,text,vec_id,embedding_model,embedding_dim,embedding,"
            "index_type,index_measurement\n")
    line = "1,2024-01-01T00:00:00.000000Z,s,\"a, \"\"b\"\"\",1,m,2,\"[1.5, 2]\",,\n"
    with gzip.open(path + "/a.csv.gz", "wt") as f:
        f.write(head + line)
    with bz2.open(path + "/b.csv.bz2", "wt") as f:
        f.write(head + line.replace("1,2024", "2,2024", 1))
    import zstandard
    with open(path + "/c.csv.zst", "wb") as f:
        f.write(zstandard.ZstdCompressor().compress((head + line.replace("1,2024", "3,2024", 1)).encode()))
    rows = sorted(csv_io.read_csv(spark, path).collect(), key=lambda r: r.trans_id)
    assert [(r.trans_id, r.text, r.embedding, r._corrupt) for r in rows] == \
        [(i, 'a, "b"', [1.5, 2.0], None) for i in (1, 2, 3)]


def test_table_description_json(spark):
    import json

    from mnemospark.operators import profile as PR
    prof = PR.table_profile("messages", messages(spark, SF_SMALL), keys={"pk": ["trans_id"]},
                            comments={"text": "message body"})
    desc = json.loads(PR.describe_json(prof).first()._j)
    cols = [d["c"] for d in desc]
    assert [c["column_name"] for c in cols] == messages(spark, SF_SMALL).columns
    assert cols[0]["keys"] == "pk" and cols[0]["keys_unique"] is True
    assert [c for c in cols if c["column_name"] == "text"][0]["comment"] == "message body"


def test_export_runs_increment_and_append(spark):
    import datetime as dt

    from mnemospark.sources import export as EX
    root = work_dir(spark, "t-export")
    rows = stamped(spark).limit(10)
    p1 = EX.export_run(rows, root, "all_records", dt.date(2025, 1, 2))
    p2 = EX.export_run(rows, root, "all_records", dt.date(2025, 1, 2))
    p3 = EX.export_run(rows, root, "all_records", dt.date(2025, 1, 2), auto_increment=False)
    assert p1.endswith("run=1") and p2.endswith("run=2") and p3 == p2
    assert csv_io.read_csv(spark, p2).count() == 20 and csv_io.read_csv(spark, p1).count() == 10
    assert EX.last_run(spark, root, "other") is None


def test_export_appends_to_the_newest_run_of_any_day(spark, monkeypatch):
    import datetime as dt

    from mnemospark.sources import export as EX
    root, rows = work_dir(spark, "t-export-days"), stamped(spark).limit(10)
    first = EX.export_run(rows, root, "m", dt.date(2024, 1, 1))
    again = EX.export_run(rows, root, "m", dt.date(2024, 1, 2), auto_increment=False)
    assert again == first and "date=2024-01-01" in first and EX.read_run(spark, first).count() == 20
    # a crash halfway: the run is recorded, a retry rewrites its own batch

    def broken(df, path, **options):
        real(df.limit(3), path, **options)
        raise OSError("lost")
    real = csv_io.write_csv
    with monkeypatch.context() as m:
        m.setattr(csv_io, "write_csv", broken)
        with pytest.raises(OSError):
            EX.export_run(rows, root, "m", dt.date(2024, 1, 3), batch_id="b")
    run = EX.last_run(spark, root, "m")
    path = EX.export_run(rows, root, "m", dt.date(2024, 1, 4), batch_id="b", run=run)
    assert run == 2 and "date=2024-01-03" in path and EX.read_run(spark, path).count() == 10
    assert EX.export_run(rows, root, "m", dt.date(2024, 1, 4)).endswith("date=2024-01-04/run=3")
    with pytest.raises(ValueError):
        EX.export_run(rows, root, "m", run=9)


def test_profile_all_and_now(spark):
    from mnemospark.operators import profile as PR
    from mnemospark.operators.search import day_bounds, now
    from mnemospark.sources.tables import table
    prof = PR.profile_all({t: table(spark, SF_SMALL, t) for t in ("labels", "benchmark")},
                          {"labels": {"pk": ["doc_id"]}})
    assert {r.table_name for r in prof.collect()} == {"labels", "benchmark"}
    s, e = day_bounds(None, 0)
    assert s <= now() < e


def test_append_with_ingest_id_is_idempotent(spark):
    st = ST.MessageStore(spark, work_dir(spark, "t-idem"), LONG_TERM_CHUNK_SECONDS)
    rows = stamped(spark)
    dup = rows.limit(3).withColumn("seq", F.col("seq") + 10**9)  # replays: rejected as pk
    batch = rows.unionByName(dup)
    acc1, rej1 = st.append(batch, "s", ingest_id="b0")
    n_acc, rej_set = acc1.count(), sorted((r.seq, r.reject_reason) for r in rej1.collect())
    # a replay of the same batch: same rejects, nothing stored twice
    acc2, rej2 = st.append(batch, "s", ingest_id="b0")
    assert sorted((r.seq, r.reject_reason) for r in rej2.collect()) == rej_set
    assert st.read().count() == n_acc
    # a partly written first attempt, with a row that the replay does not have
    st2 = ST.MessageStore(spark, work_dir(spark, "t-idem2"), LONG_TERM_CHUNK_SECONDS)
    part = ST.prepare(rows.limit(5).withColumn("speaker", F.lit("half")), "s", LONG_TERM_CHUNK_SECONDS)
    ST.write_rows(part, st2.ingest_path(0, "b0"), "append")
    st2._record_version(0, -1, "create")
    _, rej3 = st2.append(batch, "s", ingest_id="b0")
    assert sorted((r.seq, r.reject_reason) for r in rej3.collect()) == rej_set
    assert st2.read().count() == n_acc and st2.read().filter("speaker = 'half'").count() == 0
    assert st2.read().groupBy("seq").count().filter("count > 1").count() == 0
    with pytest.raises(ValueError):
        st2.append(batch, "s", ingest_id="../b0")


def test_csv_to_long_term_store(spark):
    """CSV -> typed read -> arrival order -> checks -> append (the bulk load)."""
    path = work_dir(spark, "t-load") + "/in"
    rows = stamped(spark).drop("seq")
    csv_io.write_csv(rows, path, mode="errorifexists")
    back = csv_io.with_arrival(csv_io.read_csv(spark, path)).drop("_corrupt")
    st = ST.MessageStore(spark, work_dir(spark, "t-load-store"), LONG_TERM_CHUNK_SECONDS)
    acc, rej = st.append(back, "load")
    assert acc.count() == rows.count() and rej.count() == 0
    assert st.read().select("trans_id").exceptAll(rows.select("trans_id")).count() == 0


def test_reset_cuts_files_and_keeps_rows(spark):
    import glob
    root = work_dir(spark, "t-compact")
    st = ST.MessageStore(spark, root, LONG_TERM_CHUNK_SECONDS)
    rows = stamped(spark)
    for i in range(3):  # three appends of disjoint rows: three file sets
        st.append(rows.filter(F.col("trans_id") % 3 == i), "s", ingest_id=f"{i}")
    assert {r["ingest_id"] for r in st.read().select("ingest_id").distinct().collect()} == {"i-0", "i-1", "i-2"}
    before = ST.manifest(st.read().drop("ingest_id"))
    files_before = len(glob.glob(st.data_path(0) + "/*/*/*/*.parquet"))
    st.snapshot(root + "_snapshot")
    v = st.reset(F.lit(True), root + "_snapshot")
    assert v == 1 and ST.manifest(st.read().drop("ingest_id")) == before
    assert len(glob.glob(st.data_path(1) + "/*/*/*/*.parquet")) <= files_before


def test_arrival_numbers_are_dense_in_file_order(spark):
    path = work_dir(spark, "t-arrival")
    rows = stamped(spark).drop("seq")
    for i, part in enumerate([rows.filter(F.col("trans_id") < 300), rows.filter(F.col("trans_id") >= 300)]):
        csv_io.write_csv(part.orderBy("trans_id").coalesce(1), f"{path}/f{i}", mode="errorifexists")
    back = csv_io.with_arrival(csv_io.read_csv(spark, path + "/*"))
    got = [r.trans_id for r in back.orderBy("seq").select("trans_id").collect()]
    assert [r.seq for r in back.orderBy("seq").select("seq").collect()] == list(range(rows.count()))
    assert got == sorted(got)  # f0 (ids < 300) before f1, each file in line order


def test_line_safe_files_are_read_by_several_tasks(spark):
    """Texts of several lines survive; one file is cut into byte ranges and
    arrival numbers still follow its lines."""
    path = work_dir(spark, "t-line-safe") + "/in"
    hard = F.array(*[F.lit(t) for t in ("a\nb\r\nc", "\\n", "\\\\\n\\", "  x \t", "", "\\N", 'q","\n"', "\u2028é")])
    rows = stamped(spark).drop("seq").withColumn(
        "text", F.concat(F.element_at(hard, (F.col("trans_id") % 8 + 1).cast("int")),
                         F.when(F.col("trans_id") % 16 < 8, "").otherwise(F.col("text"))))
    rows = rows.withColumn("text", F.when(F.col("trans_id") % 50 != 0, F.col("text")))
    csv_io.write_csv(rows.orderBy("trans_id").coalesce(1), path, mode="errorifexists", line_safe=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = csv_io.read_csv(spark, path, line_safe=True)
        assert read.select(F.spark_partition_id()).distinct().count() > 4
        back = csv_io.with_arrival(read).orderBy("seq").select("seq", "trans_id", "text", "_corrupt").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = rows.orderBy("trans_id").select("trans_id", "text").collect()
    assert [(r.seq, r.trans_id, r.text, r._corrupt) for r in back] == [
        (i, w.trans_id, w.text, None) for i, w in enumerate(want)]


def test_running_total(spark):
    from mnemospark.operators.numbering import running_total
    rows = [(i * 7 % 101, i % 5) for i in range(101)]
    got = running_total(spark.createDataFrame(rows, "at int, n long"), ["at"], "n", "before").collect()
    values = [n for _, n in sorted(rows)]
    assert sorted((r.at, r.before) for r in got) == [(i, sum(values[:i])) for i in range(101)]
    assert running_total(spark.createDataFrame([], "at int, n long"), ["at"], "n", "before").count() == 0


def test_empty_export_writes_header_only(spark):
    import glob

    from mnemospark.schema import STORE_SCHEMA
    path = work_dir(spark, "t-empty") + "/out"
    csv_io.write_csv(spark.createDataFrame([], STORE_SCHEMA), path, mode="errorifexists")
    files = glob.glob(path + "/*.csv")
    assert len(files) == 1 and open(files[0]).read().startswith("trans_id,timestamp,speaker,text")
    assert csv_io.read_csv(spark, path).count() == 0


def _fail_once(monkeypatch, owner, name):
    real, state = getattr(owner, name), {"left": 1}

    def broken(*args, **kwargs):
        if state["left"]:
            state["left"] -= 1
            raise OSError("lost")
        return real(*args, **kwargs)
    monkeypatch.setattr(owner, name, broken)


def _twenty(spark, first=0):
    return spark.createDataFrame(
        [(i, "2025-01-01 00:00:00", f"s{i}", "x", i, "m", 2, [1.0, 2.0], None, None, i) for i in range(first, first + 20)],
        "trans_id long, timestamp string, speaker string, text string, vec_id long, embedding_model string, "
        "embedding_dim int, embedding array<float>, index_type string, index_measurement string, seq long"
    ).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


@pytest.mark.parametrize("later", [False, True])
@pytest.mark.parametrize("step", ["check", "record", "before", "halfway", "after", "recorded"])
def test_replay_of_a_failed_batch_stores_rows_once(spark, tmp_path, monkeypatch, step, later):
    """A failure at every step of a first and of a later batch."""
    store = ST.MessageStore(spark, str(tmp_path / "s"), model="m", dim=2)
    if later:
        store.append(_twenty(spark, 100), "a", ingest_id="earlier")
    batch = _twenty(spark).unionByName(_twenty(spark).withColumn("seq", F.col("seq") + 1000))
    real = ST.write_rows

    def halfway(df, path, mode="append"):
        real(df.filter("trans_id < 7"), path, mode)
        raise OSError("lost")

    def after(df, path, mode="append"):
        real(df, path, mode)
        raise OSError("lost")

    def fail(*args, **kwargs):
        raise OSError("lost")
    with monkeypatch.context() as m:
        if step == "check":
            m.setattr(I, "check_batch", fail)
        elif step in ("record", "recorded"):
            _fail_once(m, ST.MessageStore, "_record_version" if step == "record" else "_recorded_rows")
        else:
            m.setattr(ST, "write_rows", {"before": fail, "halfway": halfway, "after": after}[step])
        if step == "record" and later:
            store.append(batch, "a", ingest_id="b0")  # no version is recorded then
        else:
            with pytest.raises(OSError):
                store.append(batch, "a", ingest_id="b0")
    accepted, rejected = store.append(batch, "a", ingest_id="b0")
    assert (accepted.count(), rejected.count()) == (20, 20)
    assert store.read().count() == (40 if later else 20)
    assert {r["reject_reason"] for r in rejected.select("reject_reason").distinct().collect()} == {"pk"}
    # counted as holding rows, so that losing them is an error
    assert store._recorded_rows(store.current_version()) > 0
    import shutil
    shutil.copytree(tmp_path / "s" / "_versions", tmp_path / "lost" / "_versions")
    with pytest.raises(Exception):
        ST.MessageStore(spark, str(tmp_path / "lost"), model="m", dim=2).read()


def test_read_errors_are_not_an_empty_store(spark, tmp_path, monkeypatch):
    from mnemospark.sources.store import MessageStore
    store = MessageStore(spark, str(tmp_path / "s"))
    assert store.current_version() is None
    store._record_version(0, 5, "create")
    with pytest.raises(Exception):
        store.read()


def test_promote_strict_adds_all_or_none(spark):
    root = work_dir(spark, "t-promote")
    rows = I.stamp_provenance(messages(spark, SF_SMALL), "m", 64).withColumn("seq", F.col("trans_id"))
    store = ST.MessageStore(spark, root, LONG_TERM_CHUNK_SECONDS, "m", 64)
    store.append(rows.filter("trans_id < 50"), "long")
    with pytest.raises(ValueError):
        store.promote(rows.filter("trans_id between 40 and 60"), "short", strict=True)
    assert store.read().count() == rows.filter("trans_id < 50").count()
    added, rest = store.promote(rows.filter("trans_id between 40 and 60"), "short")
    assert {r["reject_reason"] for r in rest.collect()} == {"pk_stored"}
    assert added.count() + rows.filter("trans_id < 50").count() == store.read().count()


def _tables(spark, root, n=60):
    spark.range(n).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-10' + make_dt_interval(cast(id % 9 as int))").alias("ts"),
                          (F.col("id") % 4).alias("user_id"), F.lit("click").alias("event_type")).write.parquet(f"{root}/events.parquet")
    spark.range(5).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: (x * F.col("id")).cast("float"))
                          .alias("embedding")).write.parquet(f"{root}/embeddings.parquet")
    spark.range(3).select(F.col("id").alias("item_id"), F.concat(F.lit("text "), "id").alias("text")).write.parquet(f"{root}/benchmark.parquet")


def test_arrival_writes_no_vectors_that_are_not_asked_for(spark, tmp_path, monkeypatch):
    from mnemospark.plans import q_store
    _tables(spark, tmp_path)
    written, plain = [], csv_io.materialize
    monkeypatch.setattr(csv_io, "materialize", lambda df, name: written.append((name, df.columns)) or plain(df, name))
    rows = q_store.csv_arrival(spark, str(tmp_path)).collect()
    assert sorted((r["trans_id"], r["seq"]) for r in rows) == [(i, i) for i in range(60)]
    assert [("embedding" in c, "_corrupt" in c) for n, c in written if n == "arrival"] == [(False, True)]


@pytest.mark.parametrize("ingests", [1, 2])
def test_reset_deals_only_several_ingests_anew(spark, monkeypatch, ingests):
    root = work_dir(spark, "t-reset-layout")
    st = ST.MessageStore(spark, root, 86400, "m", 4)
    rows = _twenty(spark)
    for i in range(ingests):
        part = rows.filter(F.col("seq") % ingests == i)
        st.put(ST.prepare(part, F.when(F.col("seq") < 7, "a").otherwise("b"), 86400), f"p{i}")
    st.snapshot(root + "_snap")
    dealt, plain = [], ST._layout
    monkeypatch.setattr(ST, "_layout", lambda df: dealt.append(1) or plain(df))
    st.reset(F.col("session_id") != "a", root + "_snap")
    assert len(dealt) == ingests - 1
    assert st.read().count() == rows.filter("seq >= 7").count()
    assert {r["session_id"] for r in st.read().select("session_id").distinct().collect()} == {"b"}
