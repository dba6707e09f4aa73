"""Physical plan shapes the design relies on (checked on the executed plan)."""

import datetime as dt

import pytest

from mnemospark.operators import search as S
from mnemospark.plans.common import label_centroids
from mnemospark.sources.tables import messages, table
from tests.conftest import SF_MID


def plan_of(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def q(spark):
    return table(spark, SF_MID, "embeddings").select("embedding").first()[0]


def test_single_query_is_take_ordered_without_table_shuffle(spark, q):
    top = S.search(messages(spark, SF_MID), q, k=5, start=dt.datetime(2024, 1, 3), end=dt.datetime(2024, 1, 4))
    p = plan_of(top)
    assert "TakeOrderedAndProject" in p
    scan = [ln for ln in top._jdf.queryExecution().executedPlan().toString().splitlines() if "events" in ln]
    assert any("GreaterThanOrEqual(ts" in ln for ln in scan), scan  # time filter reaches the scan


def test_column_pruning(spark, q):
    top = S.exact_top_k(table(spark, SF_MID, "embeddings"), q, 5, id_col="vec_id", columns=[])
    p = plan_of(top)
    assert "label" not in p.split("ReadSchema")[1].split("\n")[0]


def test_batch_topk_limits_before_shuffle(spark):
    emb = table(spark, SF_MID, "embeddings")
    for method in ("arrow", "sql"):
        p = plan_of(S.batch_top_k(emb, label_centroids(emb), k=5, method=method))
        assert "WindowGroupLimit" in p and "Partial" in p, method


def test_two_stage_broadcasts_only_candidates(spark, q):
    emb = table(spark, SF_MID, "embeddings")
    p = plan_of(S.two_stage_top_k(emb, q, k=5))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p
    assert p.count("TakeOrderedAndProject") >= 2


def test_two_stage_on_stored_signatures_reads_ids_and_sigs(spark, q):
    from pyspark.sql import functions as F

    from mnemospark.operators import integrity as I
    from mnemospark.schema import LONG_TERM_CHUNK_SECONDS
    from mnemospark.session import work_dir
    from mnemospark.sources import store as ST
    path = work_dir(spark, "t-sig")
    rows = I.stamp_provenance(messages(spark, SF_MID), "m", 64).withColumn("seq", F.col("trans_id"))
    ST.write_rows(ST.prepare(rows, "s", LONG_TERM_CHUNK_SECONDS), path, "errorifexists")
    stored = spark.read.parquet(path)
    top = S.two_stage_top_k(stored, q, k=5, id_col="trans_id", sig_col="sig")
    on_the_fly = S.two_stage_top_k(stored, q, k=5, id_col="trans_id")
    assert [r.trans_id for r in top.collect()] == [r.trans_id for r in on_the_fly.collect()]
    schemas = [ln for ln in plan_of(top).splitlines() if "ReadSchema" in ln or "FileScan" in ln]
    assert any("sig" in ln and "embedding" not in ln for ln in schemas), schemas


def test_day_search_prunes_chunks(spark, q):
    from pyspark.sql import functions as F

    from mnemospark.operators import integrity as I
    from mnemospark.schema import SHORT_TERM_CHUNK_SECONDS
    from mnemospark.session import work_dir
    from mnemospark.sources import store as ST
    from tests.conftest import SF_SMALL
    path = work_dir(spark, "t-prune")
    rows = I.stamp_provenance(messages(spark, SF_SMALL), "m", 64).withColumn("seq", F.col("trans_id"))
    ST.write_rows(ST.prepare(rows, "s", SHORT_TERM_CHUNK_SECONDS), path, "errorifexists")
    stored = spark.read.parquet(path)
    day = (dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 11))
    top = S.search(stored, q, k=5, start=day[0], end=day[1], chunk_seconds=SHORT_TERM_CHUNK_SECONDS)
    res = top.collect()
    assert all(day[0] <= r.timestamp < day[1] for r in res)
    scan = [ln for ln in plan_of(top).splitlines() if "FileScan" in ln or "PartitionFilters" in ln]
    assert any("PartitionFilters: [" in ln and "chunk" in ln.split("PartitionFilters: [")[1] for ln in scan), scan
