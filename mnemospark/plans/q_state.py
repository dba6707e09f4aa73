"""Registered relation, conversation and embedding queries
(J1, J3-J6, A6, M1-M3, M5, M6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversation as C
from ..operators import embed as E
from ..operators import integrity as I
from ..operators import relations as R
from ..operators import search as S
from ..schema import LONG_TERM_CHUNK_SECONDS
from ..session import work_dir
from ..sources.store import MessageStore
from ..sources.tables import as_ntz, messages, table
from .common import (SQL_CENTROIDS_CTE, SQL_DIST, SQL_MESSAGES_CTE, SQL_PROBE_CTE, label_centroids,
                     probe_vector, r6)
from .registry import register

MODEL, DIM = "testdata-64", 64
FK_STRIDE = 37  # fixed: vectors built from `embeddings` point at transcription vec_id * 37


def _pair(spark, sf_dir):
    m = I.stamp_provenance(messages(spark, sf_dir), MODEL, DIM, "diskann", "vector_cosine_ops")
    return R.split(m)


@register("join_pair_topk", ("J1", "K1"), f"""
with {SQL_MESSAGES_CTE}, {SQL_PROBE_CTE},
r as (select m.trans_id, m.speaker, {SQL_DIST['cosine']('m.embedding', 'q.qv')} as distance from messages m, q)
select trans_id, speaker, round(distance, 6) as distance from r order by distance, trans_id limit 5
""")
def join_pair_topk(spark, sf_dir):
    t, v = _pair(spark, sf_dir)
    top = S.exact_top_k(R.compose(t, v), probe_vector(spark, sf_dir), 5, columns=["speaker"])
    return top.select("trans_id", "speaker", r6("distance").alias("distance"))


@register("split_compose", "J6", f"""
with {SQL_MESSAGES_CTE}
select trans_id, timestamp, speaker, vec_id, '{MODEL}' as embedding_model, {DIM} as embedding_dim,
       len(embedding) as emb_len, 'diskann' as index_type from messages
""")
def split_compose(spark, sf_dir):
    t, v = _pair(spark, sf_dir)
    back = R.compose(t, v)
    return as_ntz(back.select("trans_id", "timestamp", "speaker", "vec_id", "embedding_model", "embedding_dim",
                              F.size("embedding").cast("long").alias("emb_len"), "index_type"))


def _fk_pair(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("speaker"))
    v = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), (F.col("vec_id") * FK_STRIDE).alias("transcription_id"))
    return t, v


@register("fk_orphans", "J3", f"""
select v.vec_id as id, v.vec_id * {FK_STRIDE} as transcription_id from embeddings v
where not exists (select 1 from events e where e.event_id = v.vec_id * {FK_STRIDE})
""")
def fk_orphans(spark, sf_dir):
    t, v = _fk_pair(spark, sf_dir)
    return R.orphans(v, t).select("id", "transcription_id")


@register("cascade_delete", "J4", f"""
select v.vec_id as id, v.vec_id * {FK_STRIDE} as transcription_id,
       case when e.event_id is null then 'orphan' else 'cascade' end as reason
from embeddings v left join events e on e.event_id = v.vec_id * {FK_STRIDE}
where e.event_id is null or e.event_type = 'error'
""")
def cascade_delete(spark, sf_dir):
    t, v = _fk_pair(spark, sf_dir)
    _, _, deleted = R.cascade_delete(t, v, F.col("speaker") == "error")
    return deleted.select("id", "transcription_id", "reason")


@register("one_to_one", "J5", f"""
with {SQL_MESSAGES_CTE}
select vec_id as transcription_id, count(*) as vectors from messages group by vec_id having count(*) > 1
""")
def one_to_one(spark, sf_dir):
    m = messages(spark, sf_dir)
    v = m.select(F.col("trans_id").alias("id"), F.col("vec_id").alias("transcription_id"))
    return R.one_to_one_violations(v)


@register("history", "A6", """
select conv_id as thread_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) order by turn) as history,
       count(*) as messages
from conversations group by conv_id
""")
def history(spark, sf_dir):
    return C.history_text(C.from_turns(table(spark, sf_dir, "conversations")))


SYSTEM = "You are a helpful assistant. Answer from the stored messages."


@register("prompt", "M3", f"""
select conv_id as thread_id,
       'system: ' || '{SYSTEM}' || chr(10) || string_agg(role || ': ' || coalesce(text, ''), chr(10) order by turn)
         as prompt,
       count(*) + 1 as messages
from conversations group by conv_id
""")
def prompt(spark, sf_dir):
    return C.prompt(C.from_turns(table(spark, sf_dir, "conversations")), SYSTEM)


@register("prompt_rows", ("M3", "A6"), f"""
select conv_id as thread_id, 0 as position, 'system' as role, '{SYSTEM}' as text from conversations group by conv_id
union all
select conv_id, row_number() over (partition by conv_id order by turn), role, text from conversations
""")
def prompt_rows(spark, sf_dir):
    return C.prompt_rows(C.from_turns(table(spark, sf_dir, "conversations")), SYSTEM)


EDIT_SEQ = 10**9  # fixed: seq of the re-sent (edited) assistant messages


@register("message_upsert", "M2", f"""
with s as (select conv_id as thread_id, turn as msg_id, turn as seq, role, text from conversations
           union all
           select conv_id, turn, turn + {EDIT_SEQ}, role, 'edited: ' || text from conversations
           where role = 'assistant'),
r as (select *, row_number() over (partition by thread_id, msg_id order by seq desc) as rn,
             min(seq) over (partition by thread_id, msg_id) as first_seq from s)
select thread_id, msg_id, first_seq as seq, role, text from r where rn = 1
""")
def message_upsert(spark, sf_dir):
    st = C.from_turns(table(spark, sf_dir, "conversations"))
    edits = (st.filter(F.col("role") == "assistant")
             .withColumn("seq", F.col("seq") + F.lit(EDIT_SEQ))
             .withColumn("text", F.concat(F.lit("edited: "), F.col("text"))))
    return C.upsert(st.unionByName(edits))


@register("reply_union", ("M6", "F1"), """
select conv_id as thread_id, turn, role, length(text) as n_chars from conversations
where text is distinct from '' and role is distinct from 'assistant'
union all
select conv_id, turn, role, length(text) from conversations where role = 'assistant'
""")
def reply_union(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("thread_id"), "turn", F.col("role").alias("speaker"), "text")
    users = I.keep_messages(c, bot="assistant")
    replies = c.filter(F.col("speaker") == "assistant")
    out = C.with_replies(users, replies)
    return out.select("thread_id", "turn", F.col("speaker").alias("role"),
                      F.length("text").cast("long").alias("n_chars"))


@register("context_rows", ("M5", "K4"), f"""
with {SQL_MESSAGES_CTE}, {SQL_CENTROIDS_CTE},
d as (select c.query_id, m.trans_id, m.text, {SQL_DIST['cosine']('m.embedding', 'c.query_vec')} as distance
      from centroids c, messages m),
r as (select *, row_number() over (partition by query_id order by distance, trans_id) as rank from d)
select query_id, string_agg(text, chr(10) order by rank) as context, count(*) as rows from r
where rank <= 3 group by query_id
""")
def context_rows(spark, sf_dir):
    m = messages(spark, sf_dir)
    cents = label_centroids(table(spark, sf_dir, "embeddings"))
    top = S.batch_top_k(m.select("trans_id", "text", "embedding"), cents, k=3, doc_id="trans_id")
    ranked = top.join(m.select("trans_id", "text"), "trans_id")
    return C.context_rows(ranked)


@register("hash_embed", ("M1", "P10"), f"""
with t as (select doc_id, unnest(regexp_split_to_array(lower(text), '[ \t\n\r]+')) as tok from documents),
b as (select doc_id, (('0x' || substr(md5(tok), 1, 8))::BIGINT) % {E.HASH_BUCKETS} as bucket, count(*) as n
      from t where tok <> '' group by all)
select doc_id, cast(bucket as integer) as bucket,
       round(n / sqrt(sum(n * n) over (partition by doc_id)), 6) as weight from b
""")
def hash_embed(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    w = E.hash_weights(d, "doc_id", "text")
    return w.select("doc_id", "bucket", r6("weight").alias("weight"))


@register("history_rows", "A6", """
select conv_id as thread_id, row_number() over (partition by conv_id order by turn) as position, turn as msg_id,
       role, text from conversations
""")
def history_rows(spark, sf_dir):
    return C.history_rows(C.from_turns(table(spark, sf_dir, "conversations")))


_SQL_DENSE = f"""
tok as (select id, unnest(regexp_split_to_array(lower(text), '[ \t\n\r]+')) as tok from src),
bk as (select id, (('0x' || substr(md5(tok), 1, 8))::BIGINT) % {E.HASH_BUCKETS} as bucket, count(*) as n
       from tok where tok <> '' group by all),
w as (select id, (n / sqrt(sum(n * n) over (partition by id)))::FLOAT::DOUBLE as weight from bk),
dense as (select id, {E.HASH_BUCKETS} as dims, count(*) as nonzero, round(sum(weight), 5) as total from w group by id)
"""


def _dense_columns():
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    known = F.col("embedding").isNotNull()
    return [F.when(known, F.size("embedding")).alias("dims"),
            F.when(known, F.size(F.filter("embedding", lambda x: x != 0))).cast("long").alias("nonzero"),
            F.round(total, 5).alias("total")]


@register("embed_dense", ("M1", "P10"), f"""
with src as (select doc_id as id, text from documents), {_SQL_DENSE}
select doc_id, dims, nonzero, total from documents left join dense on dense.id = documents.doc_id
""")
def embed_dense(spark, sf_dir):
    """The vectors that the ingest stream stores."""
    got = E.hash_embed(table(spark, sf_dir, "documents"), "doc_id", "text")
    return got.select("doc_id", *_dense_columns())


REPLY_STRIDE, REPLY_START = 1 << 20, 1_704_067_200_000_000  # fixed: ids of a conversation, first time in micros


@register("reply_store", ("M6", "M1", "P2", "F1", "S9"), f"""
with src as (select conv_id * {REPLY_STRIDE} + turn as id, role, text from conversations
             where role is not null and text is not null and (role = 'assistant' or text <> '')), {_SQL_DENSE}
select src.id as trans_id, make_timestamp({REPLY_START} + src.id) as timestamp, role as speaker, text, dims, nonzero,
       total from src left join dense using (id)
""")
def reply_store(spark, sf_dir):
    """Messages and, by a second source, the replies to them: embedded,
    checked and stored, then read back from the store."""
    c = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * REPLY_STRIDE + F.col("turn")
    rows = c.select(key.alias("trans_id"), F.timestamp_micros(key + F.lit(REPLY_START)).alias("timestamp"),
                    F.col("role").alias("speaker"), "text", key.alias("vec_id"), key.alias("seq"))
    store = MessageStore(spark, work_dir(spark, "replies"), LONG_TERM_CHUNK_SECONDS, "hash-64", E.HASH_BUCKETS)
    C.store_replies(store, I.keep_messages(rows, "assistant"), rows.filter("speaker = 'assistant'"), "s0",
                    "hash-64", E.HASH_BUCKETS)
    return as_ntz(store.read().select("trans_id", "timestamp", "speaker", "text", *_dense_columns()))
