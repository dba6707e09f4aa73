"""Ingest rules: arrival-order keys, row checks, store clashes, reports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import integrity as I
from mnemospark.schema import STORE_FIELDS

D1 = dt.datetime(2025, 1, 1)
D2 = dt.datetime(2025, 1, 2)
VEC = [0.1, 0.2, 0.3]
SCHEMA = ("trans_id long, timestamp timestamp, speaker string, text string, vec_id long, "
          "embedding_model string, embedding_dim int, embedding array<float>, index_type string, "
          "index_measurement string, seq long")


def rows(spark, data):
    full = [(t, ts, s, x, 1, "m", 3, e, None, None, q) for (q, t, ts, s, x, e) in data]
    return spark.createDataFrame(full, SCHEMA)


def decided(accepted, rejected):
    acc = {r.seq: "accept" for r in accepted.collect()}
    rej = {r.seq: r.reject_reason for r in rejected.collect()}
    assert not set(acc) & set(rej)
    return {**acc, **rej}


def test_arrival_order_fixture(spark):
    b = rows(spark, [(1, 1, D1, "s", "x", VEC), (2, 1, D1, "s2", "y", VEC), (3, 2, D1, "s2", "y", VEC),
                     (4, 3, D1, "s2", "y", VEC), (5, 9, D2, "a", "b", VEC)])
    acc, rej = I.check_batch(b)
    assert decided(acc, rej) == {1: "accept", 2: "pk", 3: "accept", 4: "unique", 5: "accept"}


def test_short_chain_is_folded_at_once(spark):
    # 1:(a,x) 2:(a,y) 3:(b,y) 4:(b,z) 5:(c,z): alternate keys along a chain.
    data = [(1, 10, D1, "s", "x", VEC), (2, 10, D1, "s", "y", VEC), (3, 11, D1, "s", "y", VEC),
            (4, 11, D1, "s", "z", VEC), (5, 12, D1, "s", "z", VEC)]
    acc, rej, rounds = I.resolve_keys(rows(spark, data))
    assert sorted(r.seq for r in acc.collect()) == [1, 3, 5]
    assert {r.seq: r.reject_reason for r in rej.collect()} == {2: "pk", 4: "pk"}
    assert rounds == 1


def one_by_one(data):
    pks, uks, want = set(), set(), {}
    for seq, t, ts, s, x, _ in sorted(data):
        if (t, ts) in pks:
            want[seq] = "pk"
        elif (ts, s, x) in uks:
            want[seq] = "unique"
        else:
            want[seq] = "accept"
            pks.add((t, ts))
            uks.add((ts, s, x))
    return want


@pytest.mark.parametrize("order", ["along", "shuffled"])
def test_long_chain_needs_few_rounds(spark, monkeypatch, order):
    """A chain of 600 rows at one time with too many to fold untold."""
    import random
    monkeypatch.setattr(I, "FOLD_ROWS", 10)
    n = 600
    seqs = list(range(n))
    if order == "shuffled":
        random.Random(1).shuffle(seqs)
    data = [(q, k // 2, D1, "s", f"t{(k + 1) // 2}", VEC) for k, q in enumerate(seqs)]
    acc, rej, rounds = I.resolve_keys(rows(spark, data))
    assert decided(acc, rej) == one_by_one(data)
    assert rounds <= 2 + 2 * n.bit_length()


def test_crowded_time_equals_one_by_one(spark, monkeypatch):
    """Hot keys, chains and loners at one time, by the path of crowded times."""
    import random
    monkeypatch.setattr(I, "FOLD_ROWS", 20)
    rnd = random.Random(11)
    data = [(q, 1 if rnd.random() < 0.3 else rnd.randint(2, 90), rnd.choice([D1, D1, D1, D2]), "s",
             "hot" if rnd.random() < 0.3 else f"t{rnd.randint(1, 80)}", VEC) for q in range(400)]
    acc, rej = I.check_batch(rows(spark, data))
    assert decided(acc, rej) == one_by_one(data)


def test_uncontested_rows_are_not_shuffled(spark):
    """Full rows meet the rejects by a broadcast and keep their partitions."""
    b = rows(spark, [(i, i, D1, "s", f"t{i}", VEC) for i in range(50)] + [(50, 1, D1, "s", "x", VEC)])
    acc, _ = I.check_batch(b)
    acc.collect()
    plan = acc._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in final and "Exchange hashpartitioning" not in final


def test_brute_force_equivalence(spark):
    import random
    rnd = random.Random(7)
    data = []
    for seq in range(1, 301):
        data.append((seq, rnd.randint(1, 40), D1 if rnd.random() < 0.7 else D2,
                     rnd.choice("ab"), rnd.choice(["x", "y", "z"]), VEC))
    acc, rej = I.check_batch(rows(spark, data))
    got = decided(acc, rej)
    pks, uks, want = set(), set(), {}
    for seq, t, ts, s, x, _ in sorted(data):
        if (t, ts) in pks:
            want[seq] = "pk"
        elif (ts, s, x) in uks:
            want[seq] = "unique"
        else:
            want[seq] = "accept"
            pks.add((t, ts))
            uks.add((ts, s, x))
    assert got == want


def test_row_faults(spark):
    b = rows(spark, [(1, 1, D1, None, "x", VEC), (2, 2, D1, "s", "x", VEC[:2]), (3, 3, D1, "s", "y", None)])
    acc, rej = I.check_batch(b)
    assert decided(acc, rej) == {1: "null:speaker", 2: "dim_mismatch", 3: "accept"}


def test_filter_keeps_nulls_for_rejection(spark):
    b = rows(spark, [(1, 1, D1, "bot", "x", VEC), (2, 2, D1, "s", "", VEC), (3, 3, D1, None, "x", VEC),
                     (4, 4, D1, "s", None, VEC)])
    kept = sorted(r.seq for r in I.keep_messages(b, "bot").collect())
    assert kept == [3, 4]


def test_unknown_field_from_json(spark):
    recs = ['{"trans_id": 1, "speaker": "s", "timezone": "UTC"}', '{"trans_id": 2, "speaker": "s"}']
    df = spark.createDataFrame([(r,) for r in recs], "value string")
    out = df.select(I.unknown_fields("value").alias("u")).collect()
    assert out[0].u == ["timezone"] and out[1].u == []


def test_store_wins_and_rerun_adds_nothing(spark):
    b = rows(spark, [(1, 1, D1, "s", "x", VEC), (2, 2, D1, "s", "y", VEC)])
    acc, rej = I.check_batch(b)
    assert rej.count() == 0
    acc2, rej2 = I.check_batch(b, store=acc)
    assert acc2.count() == 0
    assert sorted(r.reject_reason for r in rej2.collect()) == ["pk_stored", "pk_stored"]
    c = rows(spark, [(9, 5, D1, "s", "x", VEC)])  # new id, stored unique key
    acc3, rej3 = I.check_batch(c, store=acc)
    assert acc3.count() == 0 and rej3.first().reject_reason == "unique_stored"


def test_accepted_plus_rejected_is_input(spark):
    from mnemospark.plans.q_ingest import fault_batch
    from tests.conftest import SF_SMALL
    b = fault_batch(spark, SF_SMALL)
    acc, rej = I.check_batch(b)
    assert acc.count() + rej.count() == b.count()
    assert acc.join(rej, "seq", "left_semi").count() == 0


def test_reports(spark):
    b = rows(spark, [(1, 1, D1, "s", "x", VEC), (2, 1, D1, "s2", "y", VEC), (1500, 5, D1, "s", "q", VEC)])
    acc, rej = I.check_batch(b)
    rep = {r.batch_id: (r.rows, r.accepted, r.errors, r.all_clear) for r in I.load_report(acc, rej, 1000).collect()}
    assert rep == {0: (2, 1, 1, False), 1: (1, 1, 0, True)}
    kept = I.prefix_commit(acc, rej, 1000).collect()
    assert kept == []  # batch 0 fails, so nothing from it or later is loaded
    b2 = rows(spark, [(1, 1, D1, "s", "x", VEC), (1500, 1, D1, "s2", "y", VEC)])
    acc2, rej2 = I.check_batch(b2)
    assert [r.seq for r in I.prefix_commit(acc2, rej2, 1000).collect()] == [1]


def test_store_columns_kept(spark):
    b = rows(spark, [(1, 1, D1, "s", "x", VEC)])
    acc, _ = I.check_batch(b)
    assert [c for c in acc.columns if c in STORE_FIELDS] == STORE_FIELDS
    assert acc.first().embedding_dim == 3



@pytest.mark.parametrize("seed,n_ids,n_texts", [(11, 8, 3), (23, 30, 2)])
def test_brute_force_dense_keys(spark, seed, n_ids, n_texts):
    """Small key domains: long chains of alternating clashes, many rounds."""
    import random
    rnd = random.Random(seed)
    data = [(seq, rnd.randint(1, n_ids), D1, "s", f"t{rnd.randint(1, n_texts)}", VEC) for seq in range(1, 201)]
    acc, rej = I.check_batch(rows(spark, data))
    pks, uks, want = set(), set(), {}
    for seq, t, ts, s, x, _ in data:
        if (t, ts) in pks:
            want[seq] = "pk"
        elif (ts, s, x) in uks:
            want[seq] = "unique"
        else:
            want[seq] = "accept"
            pks.add((t, ts))
            uks.add((ts, s, x))
    assert decided(acc, rej) == want



def test_arrival_order_must_be_total(spark):
    b = rows(spark, [(1, 1, D1, "s", "x", VEC), (1, 2, D1, "s", "y", VEC)])
    with pytest.raises(ValueError, match="repeat"):
        I.check_batch(b)
    with pytest.raises(ValueError, match="seq"):
        I.check_batch(b.drop("seq"))
    c = rows(spark, [(1, 1, D1, "s", "x", VEC)]).unionByName(
        rows(spark, [(2, 2, D1, "s", "y", VEC)]).withColumn("seq", F.lit(None).cast("long")))
    acc, rej = I.check_batch(c)
    assert acc.count() == 1 and rej.first().reject_reason == "null:seq"


@pytest.mark.parametrize("named", [2000, 2])
def test_store_check_reads_only_the_batchs_chunks(spark, tmp_path, named):
    rows = spark.range(400).select(F.col("id").alias("trans_id"), (F.col("id") % 20).alias("chunk"))
    rows.write.partitionBy("chunk").parquet(str(tmp_path / "store"))
    batch = spark.createDataFrame([(3,), (4,), (5,)], "chunk long")
    read = spark.read.parquet(str(tmp_path / "store")).filter(I.chunks_of(batch, named))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chunk" in plan or "PartitionFilters: [chunk" in plan
    assert {r["chunk"] for r in read.select("chunk").distinct().collect()} == {3, 4, 5}
    nothing = spark.read.parquet(str(tmp_path / "store")).filter(I.chunks_of(batch.limit(0), named))
    assert nothing.count() == 0
