"""Search operators against brute force (numpy) on the embeddings table."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import search as S
from mnemospark.plans.common import label_centroids
from mnemospark.sources.tables import messages, table
from tests.conftest import SF_MID, SF_SMALL


@pytest.fixture(scope="module")
def emb(spark):
    df = table(spark, SF_MID, "embeddings")
    rows = df.orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    X = np.array([r.embedding for r in rows], dtype=np.float64)
    return df, ids, X


def brute(X, ids, q, metric, k):
    if metric == "cosine":
        d = 1 - X @ q / (np.linalg.norm(X, axis=1) * np.linalg.norm(q))
    elif metric == "l2":
        d = np.linalg.norm(X - q, axis=1)
    else:
        d = -(X @ q)
    order = np.lexsort((ids, np.round(d, 12)))
    return [int(ids[i]) for i in order[:k]], d


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_exact_equals_full_sort(emb, metric):
    df, ids, X = emb
    q = X[3] * 0.7 + X[9] * 0.3
    got = [r.vec_id for r in S.exact_top_k(df, q.tolist(), 10, metric, id_col="vec_id", columns=[]).collect()]
    want, _ = brute(X, ids, q, metric, 10)
    assert got == want


def test_exact_plan_is_take_ordered(emb):
    df, _, X = emb
    plan = S.exact_top_k(df, X[0].tolist(), 5, id_col="vec_id", columns=[])._jdf.queryExecution() \
        .executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_two_stage_is_exact_on_candidates(emb):
    df, ids, X = emb
    q = X[5]
    top = S.two_stage_top_k(df, q.tolist(), k=5, search_list_size=100, rescore=50).collect()
    ham = np.sum((X > 0) != (q > 0), axis=1)
    cand = np.lexsort((ids, ham))[:50]
    _, d = brute(X, ids, q, "cosine", 1)
    want = sorted(cand, key=lambda i: (round(d[i], 12), ids[i]))[:5]
    assert [r.vec_id for r in top] == [int(ids[i]) for i in want]
    assert all(r.hamming <= ham[cand].max() for r in top)


def test_batch_top_k_matches_single_queries(spark, emb):
    df, ids, X = emb
    cents = label_centroids(df)
    batch = S.batch_top_k(df, cents, k=4).collect()
    cvecs = {r.query_id: np.array(r.query_vec, dtype=np.float64) for r in cents.collect()}
    for qid, qv in cvecs.items():
        got = [r.vec_id for r in sorted((r for r in batch if r.query_id == qid), key=lambda r: r.rank)]
        want, _ = brute(X, ids, qv, "cosine", 4)
        assert got == want


def test_score_pairs_blocks(spark, emb):
    df, _, _ = emb
    cents = label_centroids(df)
    full = S.score_pairs(df, cents, "ip").orderBy("query_id", "vec_id").collect()
    blocked = S.score_pairs(df, cents, "ip", max_broadcast_rows=3).orderBy("query_id", "vec_id").collect()
    assert len(full) == len(blocked) == 10 * df.count()
    assert all(a.distance == pytest.approx(b.distance) for a, b in zip(full, blocked))


def test_recall(spark, emb):
    df, _, _ = emb
    cents = label_centroids(df)
    exact = S.batch_top_k(df, cents, k=5)
    rec = S.recall(exact, exact).collect()
    assert all(r.recall == 1.0 for r in rec)


def test_filters_and_types(spark):
    m = messages(spark, SF_SMALL)
    with pytest.raises(ValueError):
        S.metadata_predicate(m.schema, [("nope", "==", 1)])
    with pytest.raises(TypeError):
        S.metadata_predicate(m.schema, [("trans_id", "==", "1")])
    with pytest.raises(ValueError):
        S.metadata_predicate(m.schema, [("trans_id", "~", 1)])
    q = m.select("embedding").first()[0]
    res = S.search(m, q, k=50, speaker="user_3", filters=[("trans_id", ">=", 100)],
                   start=dt.datetime(2024, 1, 5), end=dt.datetime(2024, 1, 25)).collect()
    assert res and all(r.speaker == "user_3" and r.trans_id >= 100 for r in res)
    assert all(dt.datetime(2024, 1, 5) <= r.timestamp < dt.datetime(2024, 1, 25) for r in res)
    assert [r.distance for r in res] == sorted(r.distance for r in res)


def test_day_bounds():
    s, e = S.day_bounds(dt.datetime(2024, 1, 17, 12), 2)
    assert (s, e) == (dt.datetime(2024, 1, 15), dt.datetime(2024, 1, 16))


def test_unknown_store(spark):
    with pytest.raises(ValueError, match="the stores are"):
        S.pick_stores({"short_term": None, "long_term": None}, ["nope"])


def test_federated_dedupes_shared_rows(spark):
    m = messages(spark, SF_SMALL)
    q = m.select("embedding").first()[0]
    top = S.federated_top_k({"a": m, "b": m}, q, k=5).collect()
    assert len({r.trans_id for r in top}) == 5 and all(r.store == "a" for r in top)


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_arrow_scan_equals_jvm(spark, emb, metric):
    df, ids, X = emb
    q = (X[11] * 0.6 + X[2] * 0.4).tolist()
    a = S.exact_top_k(df, q, 7, metric, id_col="vec_id", columns=["label"]).collect()
    b = S.exact_top_k(df, q, 7, metric, id_col="vec_id", columns=["label"], method="arrow").collect()
    assert [(r.vec_id, r.label) for r in a] == [(r.vec_id, r.label) for r in b]
    assert all(x.distance == pytest.approx(y.distance, abs=1e-12) for x, y in zip(a, b))


def test_arrow_scan_keeps_ties_and_skips_bad_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(6)] + [(9, None), (10, [0.0, 0.0]), (11, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = [r.vec_id for r in S.exact_top_k(df, [1.0, 0.0], 4, id_col="vec_id", columns=[], method="arrow").collect()]
    assert got == [0, 1, 2, 3]


def test_batch_two_stage_methods_agree(spark, emb):
    df, ids, X = emb
    cents = label_centroids(df)
    a = S.batch_two_stage_top_k(df, cents, k=5, search_list_size=100, rescore=50, method="arrow").collect()
    b = S.batch_two_stage_top_k(df, cents, k=5, search_list_size=100, rescore=50, method="sql").collect()
    key = lambda r: (r.query_id, r.rank)
    assert [(r.query_id, r.vec_id, r.rank, r.hamming) for r in sorted(a, key=key)] == \
        [(r.query_id, r.vec_id, r.rank, r.hamming) for r in sorted(b, key=key)]


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_all_pairs_arrow_equals_sql(spark, emb, metric):
    from mnemospark.operators import vector_batch as VB
    df, _, _ = emb
    cents = label_centroids(df)
    a = {(r.query_id, r.vec_id): r.distance for r in
         VB.all_pairs(df, cents, metric, "vec_id", "query_id", "embedding", "query_vec").collect()}
    b = {(r.query_id, r.vec_id): r.distance for r in S.score_pairs(df, cents, metric).collect()
         if r.distance is not None}
    assert a.keys() == b.keys() and len(a) == 10 * df.count()
    assert all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)


def test_two_stage_skips_null_and_other_lengths(spark):
    from pyspark.sql import functions as F

    from mnemospark.functions import vectors as Vf
    rows = ([(i, [1.0, float(i), -1.0]) for i in range(10)] + [(100 + i, None) for i in range(5)]
            + [(200, [1.0, 1.0])])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.withColumn("sig", F.when(F.col("embedding").isNotNull(), Vf.sign_words_expr("embedding")))
    q = [1.0, 2.0, -1.0]
    for sig_col in (None, "sig"):
        got = S.two_stage_top_k(df, q, k=3, search_list_size=4, rescore=4, sig_col=sig_col).collect()
        assert len(got) == 3 and all(r.vec_id < 100 for r in got), sig_col
    cents = spark.createDataFrame([(0, q)], "query_id long, query_vec array<float>")
    for method in ("arrow", "sql"):
        got = S.batch_two_stage_top_k(df, cents, k=3, search_list_size=4, rescore=4, method=method).collect()
        assert len(got) == 3 and all(r.vec_id < 100 for r in got), method


def test_federated_equals_brute_force(spark, emb):
    """U1 over overlapping stores equals the top-k of their deduplicated union."""
    from pyspark.sql import functions as F
    df, ids, X = emb
    base = df.select(F.col("vec_id").alias("trans_id"), F.lit(dt.datetime(2024, 1, 1)).alias("timestamp"),
                     F.lit("s").alias("speaker"), F.lit("t").alias("text"), "embedding")
    stores = {"a": base.filter(F.col("trans_id") < 300), "b": base.filter(F.col("trans_id") >= 200),
              "c": base.filter(F.col("trans_id") % 7 == 0)}
    q = (X[42] * 0.3 + X[77] * 0.7).tolist()
    got = [r.trans_id for r in S.federated_top_k(stores, q, k=8).collect()]
    want, _ = brute(X, ids, np.array(q), "cosine", 8)
    assert got == want


def test_filtered_search_arrow_equals_jvm(spark, emb):
    _, _, X = emb
    m = messages(spark, SF_SMALL)
    q = (X[3] * 0.5 + X[8] * 0.5).tolist()
    kw = dict(k=6, speaker="user_3", start=dt.datetime(2024, 1, 2), end=dt.datetime(2024, 1, 28),
              filters=[("trans_id", ">=", 10)])
    a = S.search(m, q, **kw).collect()
    b = S.search(m, q, method="arrow", **kw).collect()
    assert [(r.trans_id, r.text) for r in a] == [(r.trans_id, r.text) for r in b] and len(a) > 0


def test_score_pairs_arrow_in_blocks(spark, emb):
    df, _, _ = emb
    cents = label_centroids(df)
    small = S.score_pairs(df, cents, "ip", max_broadcast_rows=3, method="arrow")
    full = S.score_pairs(df, cents, "ip", method="arrow")
    a = {(r.query_id, r.vec_id): r.distance for r in small.collect()}
    b = {(r.query_id, r.vec_id): r.distance for r in full.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)


def test_score_pairs_arrow_is_the_same_at_every_query_count(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0])], "query_id long, query_vec array<double>")
    got = [sorted(map(tuple, S.score_pairs(docs, queries, max_broadcast_rows=n, method="arrow").collect())) for n in (1, 2, 9)]
    assert got[0] == got[1] == got[2] == [(1, 1, 0.0), (3, 1, 1.0)]


def test_batch_top_k_keeps_k_rows_of_ties(spark):
    big = 1 << 60
    docs = spark.createDataFrame([(big + i, [1.0, float(i % 2)]) for i in range(50)] + [(None, [1.0, 0.0])],
                                 "vec_id long, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "query_id long, query_vec array<double>")
    from mnemospark.operators import vector_batch as VB
    assert VB.candidates(docs, queries, 3, "l2", "vec_id", "query_id", "embedding", "query_vec").count() == 6
    for n in (1, 9):
        rows = S.batch_top_k(docs, queries, k=3, metric="l2", max_broadcast_rows=n).collect()
        assert sorted((r.query_id, r.vec_id - big) for r in rows) == [(1, 0), (1, 2), (1, 4), (2, 1), (2, 3), (2, 5)]


def test_two_stage_on_a_store_returns_each_row_once(spark):
    rows = [(i, dt.datetime(2024, 1, 1, i), i % 2, [1.0, float(i % 2)]) for i in range(10)]
    df = spark.createDataFrame(rows, "trans_id long, timestamp timestamp, vec_id long, embedding array<double>")
    got = S.two_stage_top_k(df, [1.0, 0.1], k=4, metric="l2", columns=["trans_id"]).collect()
    assert [r.trans_id for r in got] == [0, 2, 4, 6]


def test_ties_at_the_last_place_keep_k_rows_a_partition(spark):
    from mnemospark.operators import vector_batch as VB
    df = spark.range(0, 4000, 1, 3).select((F.lit(5000) - F.col("id")).alias("id"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    held = VB.single_query_candidates(df, [1.0, 0.0], 4, "cosine", "id", "embedding", ["id"], ["id"])
    assert held.count() == 12
    for method in ("arrow", "jvm"):
        got = S.exact_top_k(df, [1.0, 0.0], 4, id_col="id", columns=[], method=method).collect()
        assert [r["id"] for r in got] == [1001, 1002, 1003, 1004]


def test_methods_agree_on_rows_without_a_distance(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = [[r["id"] for r in S.exact_top_k(df, [1.0, 0.0], 9, id_col="id", columns=[], method=m).collect()] for m in ("arrow", "jvm")]
    assert got[0] == got[1] == [None, 1]
