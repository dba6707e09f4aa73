"""Stored lists: recall against brute force, the folders read, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import search as S
from mnemospark.operators import vector_index as VI
from mnemospark.session import work_dir
from mnemospark.sources.tables import table

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def index(spark):
    emb = table(spark, SF, "embeddings")
    path = work_dir(spark, "t-index")
    return emb, path, VI.build(emb, path, 64, k=10, calibrate_on=F.col("vec_id") % 50 != 0)


def test_held_out_recall_and_rows_read(spark, index):
    emb, path, settings = index
    queries = emb.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    got = VI.batch_search(path, queries, 10)
    recall = S.recall(got, S.batch_top_k(emb, queries, 10)).agg(F.avg("recall")).first()[0]
    sizes = spark.read.parquet(f"{path}/rows").groupBy("list").count().collect()
    read = settings.probes / len(settings.centroids)
    print("recall", recall, "measured", settings.measured, "lists", len(settings.centroids), "read", settings.probes, read)
    assert recall >= 0.9 and settings.measured >= VI.FLOOR
    assert sum(r["count"] for r in sizes) == emb.count()  # every row is indexed
    assert settings.probes < len(settings.centroids)


def test_single_and_batch_search_agree_and_prune(spark, index):
    emb, path, settings = index
    q = emb.filter("vec_id = 100").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    one = VI.search(spark, path, q.first()["query_vec"], 10)
    assert [r["vec_id"] for r in one.collect()] == [r["vec_id"] for r in VI.batch_search(path, q, 10).orderBy("rank").collect()]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan
    everything = VI.search(spark, path, q.first()["query_vec"], 10, probes=len(settings.centroids))
    exact = S.exact_top_k(emb, q.first()["query_vec"], 10, id_col="vec_id", columns=[])
    assert [r["vec_id"] for r in everything.collect()] == [r["vec_id"] for r in exact.collect()]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_odd_rows_have_no_list_and_hurt_nothing(spark, metric):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    rows += [(100, None), (101, []), (102, [1.0]), (103, [1.0, None, 0.0, 0.0]), (104, [float("nan")] * 4), (60, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    path = work_dir(spark, "t-index-odd")
    s = VI.build(df, path, 4, k=3, metric=metric)
    assert spark.read.parquet(f"{path}/rows").filter(F.col("list") == VI.NO_LIST).count() == 5
    got = VI.search(spark, path, rows[0][1], 3, probes=len(s.centroids)).collect()
    assert [r["vec_id"] for r in got][:2] == [0, 60]  # a tie goes to the smaller id


def test_empty_table(spark):
    path = work_dir(spark, "t-index-empty")
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert VI.build(df, path, 4).probes == 1
    assert VI.search(spark, path, [1.0, 0.0, 0.0, 0.0], 3).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_best_rows_equal_all_distances(metric, monkeypatch):
    """Tiles and the product's pre-selection change no result: ties, equal
    rows, zero, infinite and missing numbers included."""
    rng = np.random.default_rng(5)
    X = rng.normal(size=(300, 9))
    X[50:90] = X[10]
    X[90:100] = X[:10] * (1 + 1e-15)
    X[100], X[101, 3], X[102, 4], X[103] = 0, np.nan, np.inf, 1e200
    Q = np.concatenate([X[[10, 3, 100, 101, 102]], rng.normal(size=(20, 9))])
    ids = rng.permutation(300)
    monkeypatch.setattr(VI.vector_batch, "TILE_ROWS", 32)
    monkeypatch.setattr(VI.vector_batch, "TILE_QUERIES", 7)
    monkeypatch.setattr(VI.vector_batch, "EXACT_PAIRS", 50)
    kept = VI.vector_batch._Best(Q, 12, metric)
    for a in range(0, 300, 110):
        kept.offer(ids[a:a + 110], X[a:a + 110])
    with np.errstate(all="ignore"):
        D = VI.vector_batch._distances(X, Q, metric)
    for j in range(len(Q)):
        want = sorted((d, i) for d, i in zip(D[:, j].tolist(), ids.tolist()) if d == d)[:12]
        assert sorted(zip(kept.found[j][1].tolist(), kept.found[j][0].tolist())) == want


def test_batch_search_makes_no_row_of_each_pair(spark, monkeypatch):
    """Only rows without an id are paired with queries as rows."""
    rng = np.random.default_rng(6)
    rows = [(i if i < 190 else None, [float(x) for x in rng.normal(size=8)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    path, paired, plain = work_dir(spark, "t-pairs"), [], VI._pairs
    VI.build(df, path, 8, k=5, metric="l2", lists=6, calibrate_on=F.col("vec_id").isNotNull())
    queries = df.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    queries = queries.unionByName(queries.limit(1)).unionByName(queries.limit(1).withColumn("query_id", F.lit(None).cast("long")))
    monkeypatch.setattr(VI, "_pairs", lambda rows, *a: paired.append(rows.count()) or plain(rows, *a))
    got = [tuple(r) for r in VI.batch_search(path, queries, 5, probes=6).orderBy("query_id", "rank").collect()]
    assert paired == [10]
    settings = VI.load(spark, path)
    stored = spark.read.schema(settings.schema).parquet(f"{path}/rows")
    w = VI.Window.partitionBy("query_id").orderBy("distance", "vec_id")
    want = plain(stored, queries, settings, 6, "query_id", "query_vec").withColumn("rank", F.row_number().over(w))
    want = [tuple(r) for r in want.filter("rank <= 5").orderBy("query_id", "rank").collect()]
    assert [(q, v, r) for q, v, _, r in got] == [(q, v, r) for q, v, _, r in want]
    assert np.allclose([d for _, _, d, _ in got], [d for _, _, d, _ in want])
