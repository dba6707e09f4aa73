"""Registered search queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators import vector_index as VI
from ..schema import LONG_TERM_CHUNK_SECONDS
from ..session import work_dir
from ..sources import store as ST
from ..sources.tables import as_ntz, messages, table
from .common import (AS_OF, PROBE_VEC_ID, SHORT_TERM_FROM, SQL_CENTROIDS_CTE, SQL_DIST,
                     SQL_MESSAGES_CTE, SQL_PROBE_CTE, label_centroids, probe_vector, r6,
                     sql_sign_hamming, vector_of)
from .registry import register


def _nearest_sql(metric: str) -> str:
    d = SQL_DIST[metric]("e.embedding", "q.embedding")
    return f"""
with q as (select embedding from embeddings where vec_id = {PROBE_VEC_ID}),
r as (select e.vec_id, e.label, {d} as distance from embeddings e, q where e.vec_id <> {PROBE_VEC_ID})
select vec_id, label, round(distance, 6) as distance from r
where distance is not null order by distance, vec_id limit 5
"""


def _nearest(metric: str):
    def build(spark, sf_dir):
        q = vector_of(spark, sf_dir, PROBE_VEC_ID)
        emb = table(spark, sf_dir, "embeddings")
        top = S.exact_top_k(emb, q, 5, metric, id_col="vec_id", columns=["label"],
                            where=F.col("vec_id") != PROBE_VEC_ID)
        return top.select("vec_id", "label", r6("distance").alias("distance"))
    return build


for _metric, _ops in (("cosine", ("P6", "K1")), ("l2", ("P7", "K1")), ("ip", ("P8", "K1"))):
    register(f"{_metric}_topk", _ops, _nearest_sql(_metric))(_nearest(_metric))


def _messages_topk_sql(where: str, extra_cols: str = "") -> str:
    d = SQL_DIST["cosine"]("m.embedding", "q.qv")
    return f"""
with {SQL_MESSAGES_CTE}, {SQL_PROBE_CTE},
r as (select m.trans_id, m.timestamp, m.speaker, m.text, {d} as distance
      from messages m, q where {where})
select trans_id, timestamp, speaker, text, round(distance, 6) as distance{extra_cols} from r
where distance is not null order by distance, trans_id limit 5
"""


@register("filtered_topk", ("F2", "K3", "P1"), _messages_topk_sql("m.speaker = 'user_7'"))
def filtered_topk(spark, sf_dir):
    q = probe_vector(spark, sf_dir)
    top = S.search(messages(spark, sf_dir), q, k=5, speaker="user_7")
    return as_ntz(top.select("trans_id", "timestamp", "speaker", "text", r6("distance").alias("distance")))


def _day():
    as_of = dt.datetime.fromisoformat(AS_OF)
    return S.day_bounds(as_of, 2)


_DAY_START, _DAY_END = _day()


@register("day_range_topk", ("F3", "P18", "K3"), _messages_topk_sql(
    f"m.timestamp >= date_trunc('day', TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY) "
    f"and m.timestamp < date_trunc('day', TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY) + INTERVAL 1 DAY"))
def day_range_topk(spark, sf_dir):
    """The whole UTC day two days before a fixed time."""
    q = probe_vector(spark, sf_dir)
    top = S.search(messages(spark, sf_dir), q, k=5, start=_DAY_START, end=_DAY_END)
    return as_ntz(top.select("trans_id", "timestamp", "speaker", "text", r6("distance").alias("distance")))


_META_FILTERS = [("speaker", "nin", ["user_0", "user_1"]),
                 ("timestamp", "<", dt.datetime(2024, 1, 20))]


@register("metadata_topk", ("F4", "K10", "P13"), f"""
with {SQL_MESSAGES_CTE}, {SQL_PROBE_CTE},
r as (select m.trans_id, m.timestamp, m.speaker, m.text, {SQL_DIST['cosine']('m.embedding', 'q.qv')} as distance
      from messages m, q where m.speaker not in ('user_0', 'user_1') and m.timestamp < TIMESTAMP '2024-01-20')
select trans_id, timestamp, speaker, round(1 - distance, 6) as score, substring(text, 1, 100) as preview
from r where distance is not null order by distance, trans_id limit 5
""")
def metadata_topk(spark, sf_dir):
    q = probe_vector(spark, sf_dir)
    top = S.search(messages(spark, sf_dir), q, k=5, filters=_META_FILTERS)
    res = S.with_score_metadata(top)
    return as_ntz(res.select("metadata.trans_id", "metadata.timestamp", "metadata.speaker",
                             r6("score").alias("score"), "preview"))


@register("two_stage_topk", ("K2", "K5"), f"""
with q as (select embedding from embeddings where vec_id = {PROBE_VEC_ID}),
h as (select e.vec_id, e.embedding, {sql_sign_hamming('e.embedding', 'q.embedding')} as hamming
      from embeddings e, q where e.vec_id <> {PROBE_VEC_ID}),
cand as (select * from h order by hamming, vec_id limit 100),
best as (select * from cand order by hamming, vec_id limit 50),
r as (select b.vec_id, b.hamming, {SQL_DIST['cosine']('b.embedding', 'q.embedding')} as distance from best b, q)
select vec_id, cast(hamming as integer) as hamming, round(distance, 6) as distance from r order by distance, vec_id limit 5
""")
def two_stage_topk(spark, sf_dir):
    q = vector_of(spark, sf_dir, PROBE_VEC_ID)
    emb = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") != PROBE_VEC_ID)
    top = S.two_stage_top_k(emb, q, k=5, search_list_size=100, rescore=50, id_col="vec_id")
    return top.select("vec_id", F.col("hamming").cast("int").alias("hamming"), r6("distance").alias("distance"))


@register("score_matrix", ("J2", "P9"), f"""
with {SQL_CENTROIDS_CTE}
select c.query_id, e.vec_id, round(100 * list_dot_product(e.embedding::DOUBLE[], c.query_vec::DOUBLE[]), 6) as score
from centroids c, embeddings e
""")
def score_matrix(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    cents = label_centroids(emb)
    pairs = S.score_pairs(emb, cents, metric="ip", method="arrow")
    return pairs.select("query_id", "vec_id", r6(-F.col("distance") * 100).alias("score"))


@register("batch_knn", ("K4", "J2"), f"""
with {SQL_CENTROIDS_CTE},
d as (select c.query_id, e.vec_id, {SQL_DIST['cosine']('e.embedding', 'c.query_vec')} as distance
      from centroids c, embeddings e),
r as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank
      from d where distance is not null)
select query_id, vec_id, rank, round(distance, 6) as distance from r where rank <= 5
""")
def batch_knn(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    top = S.batch_top_k(emb, label_centroids(emb), k=5, metric="cosine")
    return top.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"),
                      r6("distance").alias("distance"))


@register("ann_recall", ("K6", "K5", "K4"), f"""
with {SQL_CENTROIDS_CTE},
d as (select c.query_id, e.vec_id,
             {sql_sign_hamming('e.embedding', 'c.query_vec')} as hamming,
             {SQL_DIST['cosine']('e.embedding', 'c.query_vec')} as distance
      from centroids c, embeddings e),
exact as (select query_id, vec_id from
            (select *, row_number() over (partition by query_id order by distance, vec_id) as rn from d)
          where rn <= 5),
cand as (select * from (select *, row_number() over (partition by query_id order by hamming, vec_id) as rn from d)
         where rn <= 50),
approx as (select query_id, vec_id from
             (select query_id, vec_id, row_number() over (partition by query_id order by distance, vec_id) as rn2
              from cand)
           where rn2 <= 5)
select x.query_id, round(avg(case when a.vec_id is null then 0 else 1 end), 6) as recall, count(*) as k
from exact x left join approx a on a.query_id = x.query_id and a.vec_id = x.vec_id
group by x.query_id
""")
def ann_recall(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    cents = label_centroids(emb)
    approx = S.batch_two_stage_top_k(emb, cents, k=5, search_list_size=100, rescore=50)
    exact = S.batch_top_k(emb, cents, k=5)
    rec = S.recall(approx, exact)
    return rec.select("query_id", r6("recall").alias("recall"), "k")


@register("federated_topk", ("U1", "U2", "F5"), f"""
with {SQL_MESSAGES_CTE}, {SQL_PROBE_CTE},
stores as (
  select 'short_term' as store, 0 as prio, * from messages where timestamp >= TIMESTAMP '{SHORT_TERM_FROM}'
  union all
  select 'long_term' as store, 1 as prio, * from messages),
d as (select s.*, {SQL_DIST['cosine']('s.embedding', 'q.qv')} as distance from stores s, q),
u as (select *, row_number() over (partition by trans_id, timestamp order by distance, prio) as rn
      from d where distance is not null)
select trans_id, timestamp, speaker, text, round(distance, 6) as distance, store
from u where rn = 1 order by distance, trans_id limit 5
""")
def federated_topk(spark, sf_dir):
    q = probe_vector(spark, sf_dir)
    msgs = messages(spark, sf_dir)
    registry = {
        "short_term": msgs.filter(F.col("timestamp") >= F.lit(dt.datetime.fromisoformat(SHORT_TERM_FROM))),
        "long_term": msgs,
    }
    top = S.federated_top_k(registry, q, k=5, names=["short_term", "long_term"])
    return as_ntz(top.select("trans_id", "timestamp", "speaker", "text",
                             r6("distance").alias("distance"), "store"))


@register("one_store_topk", ("U2", "F5"), f"""
with {SQL_MESSAGES_CTE}, {SQL_PROBE_CTE},
d as (select m.*, {SQL_DIST['cosine']('m.embedding', 'q.qv')} as distance from messages m, q
      where m.timestamp >= TIMESTAMP '{SHORT_TERM_FROM}')
select trans_id, timestamp, speaker, round(distance, 6) as distance, 'short_term' as store
from d where distance is not null order by distance, trans_id limit 5
""")
def one_store_topk(spark, sf_dir):
    """The stores to search are chosen by name: here one of the two."""
    msgs = messages(spark, sf_dir)
    registry = {
        "short_term": msgs.filter(F.col("timestamp") >= F.lit(dt.datetime.fromisoformat(SHORT_TERM_FROM))),
        "long_term": msgs,
    }
    top = S.federated_top_k(registry, probe_vector(spark, sf_dir), k=5, names=["short_term"])
    return as_ntz(top.select("trans_id", "timestamp", "speaker", r6("distance").alias("distance"), "store"))


@register("until_now", ("P17", "F3"), f"""
with {SQL_MESSAGES_CTE}
select speaker, count(*) as rows, max(timestamp) as last_ts from messages
where timestamp < current_timestamp::TIMESTAMP and timestamp >= TIMESTAMP '{SHORT_TERM_FROM}' group by speaker
""")
def until_now(spark, sf_dir):
    """Messages of each speaker from a fixed time to the present one."""
    since = dt.datetime.fromisoformat(SHORT_TERM_FROM)
    rows = messages(spark, sf_dir).filter(S.time_predicate(since, S.now()))
    return as_ntz(rows.groupBy("speaker").agg(F.count(F.lit(1)).alias("rows"), F.max("timestamp").alias("last_ts")))


@register("two_stage_store", ("K5", "K2"), f"""
with {SQL_MESSAGES_CTE}, q as (select embedding from embeddings where vec_id = {PROBE_VEC_ID}),
h as (select m.trans_id, m.timestamp, m.embedding, {sql_sign_hamming('m.embedding', 'q.embedding')} as hamming
      from messages m, q),
best as (select * from h order by hamming, trans_id, timestamp limit 50),
r as (select b.trans_id, b.hamming, {SQL_DIST['cosine']('b.embedding', 'q.embedding')} as distance from best b, q)
select trans_id, cast(hamming as integer) as hamming, round(distance, 6) as distance
from r order by distance, trans_id limit 5
""")
def two_stage_store(spark, sf_dir):
    """Two-stage search over a stored table: the first stage reads ids and
    the signatures written with the rows, not the vectors."""
    path = work_dir(spark, "two-stage")
    ST.write_rows(ST.prepare(messages(spark, sf_dir), "s0", LONG_TERM_CHUNK_SECONDS), path, "errorifexists")
    top = S.two_stage_top_k(spark.read.parquet(path), vector_of(spark, sf_dir, PROBE_VEC_ID), k=5,
                            id_col="trans_id", sig_col="sig")
    return top.select("trans_id", F.col("hamming").cast("int").alias("hamming"), r6("distance").alias("distance"))


@register("messages_topk", ("K1", "P1", "P6"), _messages_topk_sql("true"))
def messages_topk(spark, sf_dir):
    q = probe_vector(spark, sf_dir)
    top = S.search(messages(spark, sf_dir), q, k=5)
    return as_ntz(top.select("trans_id", "timestamp", "speaker", "text", r6("distance").alias("distance")))


@register("index_recall", ("K5", "K6"), """
select count(*) as queries, count(*) * 10 as neighbours, true as floor_met from embeddings where vec_id % 50 = 0
""")
def index_recall(spark, sf_dir):
    """The stored lists of all vectors, asked with every vector whose id 50
    divides (none of them calibrates): do they find nine tenths of the exact
    neighbours?"""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path = work_dir(spark, "vector-index")
    VI.build(emb, path, 64, k=10, calibrate_on=F.col("vec_id") % 50 != 0)
    queries = emb.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    rec = S.recall(VI.batch_search(path, queries, 10), S.batch_top_k(emb, queries, 10))
    return rec.agg(F.count(F.lit(1)).alias("queries"), F.sum("k").alias("neighbours"),
                   (F.sum(F.col("recall") * F.col("k")) >= 0.9 * F.sum("k")).alias("floor_met"))


@register("around_now", ("P17", "F3"), f"""
with {SQL_MESSAGES_CTE},
moved as (select speaker, case when trans_id % 2 = 1 then timestamp + interval 100 year else timestamp end as ts
          from messages)
select speaker, count(*) filter (ts < current_timestamp::TIMESTAMP) as until_now,
       count(*) filter (ts >= current_timestamp::TIMESTAMP) as after_now from moved group by speaker
""")
def around_now(spark, sf_dir):
    """Messages on both sides of the present: every second one lies a century
    later."""
    ts = F.when(F.col("trans_id") % 2 == 1, F.col("timestamp") + F.make_ym_interval(F.lit(100))).otherwise(F.col("timestamp"))
    moved = messages(spark, sf_dir).select("speaker", ts.alias("timestamp"))
    at = S.now()
    past = moved.filter(S.time_predicate(None, at)).groupBy("speaker").agg(F.count(F.lit(1)).alias("until_now"))
    later = moved.filter(S.time_predicate(at, None)).groupBy("speaker").agg(F.count(F.lit(1)).alias("after_now"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return past.join(later, "speaker", "full").select("speaker", zero("until_now"), zero("after_now"))
