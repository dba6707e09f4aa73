"""Registered ingest queries.

The input batch is the whole ``messages`` view in event order plus
replayed copies of every message carrying one fault each.  The fault
kind follows the event type, so each kind covers a fifth of the data:

* click:    same primary key, edited text              -> pk
* error:    new id, same (timestamp, speaker, text)   -> unique
* purchase: A same key, other speaker                 -> pk;
            B new id, A's unique key, arriving later  -> accepted in
            round two (A was rejected, so it blocks nothing)
* signup:   NULL speaker -> null:speaker;  bot reply  -> filtered (F1)
* view:     63-element vector -> dim_mismatch; NULL vector -> accepted;
            empty text        -> filtered (F1)
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import integrity as I
from ..schema import LONG_TERM_CHUNK_SECONDS
from ..session import work_dir
from ..sources.store import MessageStore
from ..sources.tables import as_ntz, messages
from .common import SHORT_TERM_FROM, SQL_MESSAGES_CTE
from .registry import register

# Fixed values of the fault replay.
BOT = "bot"
REPLAY = 10**12          # seq offset of the n-th replay
ID_SHIFT = 10**9         # id offset of replays that need a new id
MODEL, DIM = "testdata-64", 64
CHUNK_ROWS = 1000        # S2 chunk size for the load report


def base_batch(spark, sf_dir) -> DataFrame:
    m = messages(spark, sf_dir, extra=("event_type",))
    m = I.stamp_provenance(m, MODEL, DIM, None, None)
    return m.withColumn("seq", F.col("trans_id"))


# Replays per event type: (replay number n, new id offset in ID_SHIFT units or 0,
# text prefix or None, speaker change, vector change).  Fixed fault plan.
FAULTS = {
    "click": [(1, 0, "edited: ", None, None)],
    "error": [(1, 1, None, None, None)],
    "purchase": [(1, 0, None, "alt", None), (2, 2, None, "alt", None)],
    "signup": [(1, 3, None, "null", None), (2, 4, None, "bot", None)],
    "view": [(1, 5, "resent: ", None, "short"), (2, 6, "no vector: ", None, "null"), (3, 7, "", None, None)],
}


def fault_batch(spark, sf_dir) -> DataFrame:
    """One scan of the messages: each row is exploded into itself (n = 0)
    and its replays, whose columns are then rewritten by (event type, n)."""
    b = base_batch(spark, sf_dir)
    et = F.col("event_type")
    reps = F.array(F.lit(0))
    for kind, faults in FAULTS.items():
        reps = F.when(et == kind, F.array(F.lit(0), *[F.lit(f[0]) for f in faults])).otherwise(reps)
    x = b.withColumn("_n", F.explode(reps))
    n = F.col("_n")
    tid_off, text, speaker, emb = F.lit(0), F.col("text"), F.col("speaker"), F.col("embedding")
    for kind, faults in FAULTS.items():
        for num, shift, prefix, spk, vec in faults:
            hit = (et == kind) & (n == num)
            if shift:
                tid_off = F.when(hit, F.lit(shift)).otherwise(tid_off)
            if prefix is not None:
                text = F.when(hit, F.lit("") if prefix == "" else F.concat(F.lit(prefix), F.col("text"))) \
                    .otherwise(text)
            if spk == "alt":
                speaker = F.when(hit, F.concat(F.col("speaker"), F.lit("_alt"))).otherwise(speaker)
            elif spk == "null":
                speaker = F.when(hit, F.lit(None).cast("string")).otherwise(speaker)
            elif spk == "bot":
                speaker = F.when(hit, F.lit(BOT)).otherwise(speaker)
            if vec == "short":
                emb = F.when(hit, F.slice(F.col("embedding"), 1, DIM - 1)).otherwise(emb)
            elif vec == "null":
                emb = F.when(hit, F.lit(None).cast("array<float>")).otherwise(emb)
    out = x.withColumns({
        "trans_id": F.col("trans_id") + tid_off.cast("long") * F.lit(ID_SHIFT),
        "seq": F.col("seq") + n.cast("long") * F.lit(REPLAY),
        "text": text, "speaker": speaker, "embedding": emb,
    }).drop("_n", "event_type")
    return I.keep_messages(out, BOT)


def checked(spark, sf_dir):
    return I.check_batch(fault_batch(spark, sf_dir))


_SQL_BATCH = f"""
{SQL_MESSAGES_CTE.replace("b.text, v.vec_id, v.embedding", "b.text, v.vec_id, v.embedding, e.event_type")},
b as (select trans_id, timestamp, speaker, text, vec_id, '{MODEL}' as embedding_model, {DIM} as embedding_dim,
             embedding, event_type, trans_id as seq from messages),
raw as (
  select trans_id, timestamp, speaker, text, vec_id, embedding_model, embedding_dim, embedding, seq from b
  union all select trans_id, timestamp, speaker, 'edited: ' || text, vec_id, embedding_model, embedding_dim, embedding,
                   seq + {REPLAY} from b where event_type = 'click'
  union all select trans_id + {ID_SHIFT}, timestamp, speaker, text, vec_id, embedding_model, embedding_dim, embedding,
                   seq + {REPLAY} from b where event_type = 'error'
  union all select trans_id, timestamp, speaker || '_alt', text, vec_id, embedding_model, embedding_dim, embedding,
                   seq + {REPLAY} from b where event_type = 'purchase'
  union all select trans_id + {2 * ID_SHIFT}, timestamp, speaker || '_alt', text, vec_id, embedding_model,
                   embedding_dim, embedding, seq + {2 * REPLAY} from b where event_type = 'purchase'
  union all select trans_id + {3 * ID_SHIFT}, timestamp, NULL, text, vec_id, embedding_model, embedding_dim,
                   embedding, seq + {REPLAY} from b where event_type = 'signup'
  union all select trans_id + {4 * ID_SHIFT}, timestamp, '{BOT}', text, vec_id, embedding_model, embedding_dim,
                   embedding, seq + {2 * REPLAY} from b where event_type = 'signup'
  union all select trans_id + {5 * ID_SHIFT}, timestamp, speaker, 'resent: ' || text, vec_id, embedding_model,
                   embedding_dim, embedding[1:{DIM - 1}], seq + {REPLAY} from b where event_type = 'view'
  union all select trans_id + {6 * ID_SHIFT}, timestamp, speaker, 'no vector: ' || text, vec_id, embedding_model,
                   embedding_dim, NULL, seq + {2 * REPLAY} from b where event_type = 'view'
  union all select trans_id + {7 * ID_SHIFT}, timestamp, speaker, '', vec_id, embedding_model,
                   embedding_dim, embedding, seq + {3 * REPLAY} from b where event_type = 'view'),
batch as materialized (select * from raw where not (text is not distinct from '' or speaker is not distinct from '{BOT}')),
chk as (select *, case
    when trans_id is null then 'null:trans_id' when timestamp is null then 'null:timestamp'
    when speaker is null then 'null:speaker' when text is null then 'null:text'
    when vec_id is null then 'null:vec_id' when embedding_model is null then 'null:embedding_model'
    when embedding_dim is null then 'null:embedding_dim'
    when embedding is not null and len(embedding) <> embedding_dim then 'dim_mismatch' end as rr
  from batch),
g1 as (select * from chk where rr is null),
w1 as (select *, seq = min(seq) over (partition by trans_id, timestamp)
                 and seq = min(seq) over (partition by timestamp, speaker, text) as w from g1),
s1 as materialized (select *, case when w then 'accept'
                      when bool_or(w) over (partition by trans_id, timestamp) then 'pk'
                      when bool_or(w) over (partition by timestamp, speaker, text) then 'unique' end as st from w1),
g2 as (select * exclude (w, st) from s1 where st is null),
w2 as (select *, seq = min(seq) over (partition by trans_id, timestamp)
                 and seq = min(seq) over (partition by timestamp, speaker, text) as w from g2),
s2 as (select *, case when w then 'accept'
                      when bool_or(w) over (partition by trans_id, timestamp) then 'pk'
                      when bool_or(w) over (partition by timestamp, speaker, text) then 'unique' end as st from w2),
accepted as materialized (select * exclude (w, st, rr) from s1 where st = 'accept'
             union all select * exclude (w, st, rr) from s2 where st = 'accept'),
keyrej as (select * exclude (w, st, rr), st as reject_reason from s1 where st in ('pk', 'unique')
           union all select * exclude (w, st, rr), st from s2 where st in ('pk', 'unique')),
rejected as (select * exclude (rr), rr as reject_reason from chk where rr is not null
             union all
             select k.* exclude (reject_reason),
                    case when k.reject_reason = 'unique' and a.seq < k.seq then 'pk' else k.reject_reason end
             from keyrej k left join (select trans_id, timestamp, seq from accepted) a
               on a.trans_id = k.trans_id and a.timestamp = k.timestamp)
"""


@register("ingest_accepted", ("F1", "P2", "C2", "C3", "C4", "C5", "C6", "S9"), f"""
with {_SQL_BATCH}
select seq, trans_id, timestamp, speaker, text, vec_id, embedding_model, embedding_dim,
       len(embedding) as emb_len from accepted
""")
def ingest_accepted(spark, sf_dir):
    acc, _ = checked(spark, sf_dir)
    return as_ntz(acc.select("seq", "trans_id", "timestamp", "speaker", "text", "vec_id", "embedding_model",
                             "embedding_dim", F.when(F.col("embedding").isNotNull(), F.size("embedding"))
                             .cast("long").alias("emb_len")))


@register("ingest_rejected", ("S12", "P19", "C2", "C3", "C4", "C5", "C6"), f"""
with {_SQL_BATCH}
select seq, trans_id, timestamp, speaker, reject_reason from rejected
""")
def ingest_rejected(spark, sf_dir):
    _, rej = checked(spark, sf_dir)
    return as_ntz(rej.select("seq", "trans_id", "timestamp", "speaker", "reject_reason"))


@register("load_report", ("A2", "S2"), f"""
with {_SQL_BATCH},
tagged as (select seq, 1 as ok from accepted union all select seq, 0 from rejected)
select cast(floor(seq / {CHUNK_ROWS}) as bigint) as batch_id, count(*) as rows,
       cast(sum(ok) as bigint) as accepted, cast(sum(1 - ok) as bigint) as errors, sum(1 - ok) = 0 as all_clear
from tagged group by 1
""")
def load_report(spark, sf_dir):
    acc, rej = checked(spark, sf_dir)
    return I.load_report(acc, rej, CHUNK_ROWS)


@register("reject_reasons", ("A2", "P19"), f"""
with {_SQL_BATCH}
select split_part(reject_reason, ':', 1) as reason, count(*) as rows from rejected group by 1
""")
def reject_reasons(spark, sf_dir):
    _, rej = checked(spark, sf_dir)
    return I.reasons_report(rej)


@register("prefix_commit", ("A3", "S2", "S8"), f"""
with {_SQL_BATCH},
first_bad as (select min(cast(floor(seq / {CHUNK_ROWS}) as bigint)) as fb from rejected)
select a.seq, a.trans_id, cast(floor(a.seq / {CHUNK_ROWS}) as bigint) as batch_id
from accepted a, first_bad f
where f.fb is null or cast(floor(a.seq / {CHUNK_ROWS}) as bigint) < f.fb
""")
def prefix_commit(spark, sf_dir):
    acc, rej = checked(spark, sf_dir)
    return I.prefix_commit(acc, rej, CHUNK_ROWS).select("seq", "trans_id", "batch_id")


# The long-term store holds messages before LONG_TERM_UNTIL; the
# short-term store holds messages from SHORT_TERM_FROM on (two days overlap).
LONG_TERM_UNTIL = "2024-01-26 00:00:00"


@register("promote_new_rows", ("J7", "C4", "C5", "C6"), f"""
with {SQL_MESSAGES_CTE},
l as materialized (select trans_id, timestamp, speaker, text from messages where timestamp < TIMESTAMP '{LONG_TERM_UNTIL}'),
fresh as (select trans_id, timestamp, speaker, text from messages m anti join l using (trans_id, timestamp)
          where m.timestamp >= TIMESTAMP '{SHORT_TERM_FROM}')
select trans_id, timestamp, speaker from fresh anti join l using (timestamp, speaker, text)
""")
def promote_new_rows(spark, sf_dir):
    from ..sources.store import promote
    m = I.stamp_provenance(messages(spark, sf_dir), MODEL, DIM).withColumn("seq", F.col("trans_id"))
    long_term = m.filter(F.col("timestamp") < F.lit(dt.datetime.fromisoformat(LONG_TERM_UNTIL)))
    short_term = m.filter(F.col("timestamp") >= F.lit(dt.datetime.fromisoformat(SHORT_TERM_FROM)))
    new_rows, _ = promote(short_term, long_term)
    return as_ntz(new_rows.select("trans_id", "timestamp", "speaker"))


@register("promote_append", ("J7", "S8", "S9", "C4", "C5", "C6"), f"""
with {SQL_MESSAGES_CTE},
l as materialized (select trans_id, timestamp, speaker, text from messages where timestamp < TIMESTAMP '{LONG_TERM_UNTIL}')
select trans_id, timestamp, speaker, 'long' as session_id from l
union all
select trans_id, timestamp, speaker, 'short' from (select * from messages where timestamp >= TIMESTAMP '{LONG_TERM_UNTIL}')
anti join l using (timestamp, speaker, text)
""")
def promote_append(spark, sf_dir):
    """The long-term store after the short-term rows were promoted into it,
    twice with one ingest id (the second time adds nothing)."""
    m = I.stamp_provenance(messages(spark, sf_dir), MODEL, DIM).withColumn("seq", F.col("trans_id"))
    store = MessageStore(spark, work_dir(spark, "promote"), LONG_TERM_CHUNK_SECONDS, MODEL, DIM)
    store.append(m.filter(F.col("timestamp") < F.lit(dt.datetime.fromisoformat(LONG_TERM_UNTIL))), "long")
    short_term = m.filter(F.col("timestamp") >= F.lit(dt.datetime.fromisoformat(SHORT_TERM_FROM)))
    for _ in range(2):
        store.promote(short_term, "short", ingest_id="promote-1")
    return as_ntz(store.read().select("trans_id", "timestamp", "speaker", "session_id"))


@register("json_ingest", ("C1", "C2", "P3", "P19", "S12"), f"""
with {SQL_MESSAGES_CTE.replace("b.text, v.vec_id, v.embedding", "b.text, v.vec_id, v.embedding, e.event_type")}
select case when event_type <> 'signup' then trans_id end as trans_id,
       case when event_type <> 'signup' then timestamp end as timestamp,
       case when event_type <> 'signup' then speaker end as speaker,
       case event_type when 'click' then 'unknown_field:mood' when 'error' then 'type:embedding_dim'
            when 'signup' then 'corrupt_record' when 'purchase' then 'null:text' else 'accepted' end as outcome
from messages
""")
def json_ingest(spark, sf_dir):
    """Messages as JSON lines; each event type but one carries a fault: a
    field that is not stored, a length that is no number, a broken line, a
    missing text."""
    m = I.stamp_provenance(messages(spark, sf_dir, extra=("event_type",)), MODEL, DIM)
    kind = F.col("event_type")
    fields = F.struct(
        "trans_id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), "speaker",
        F.when(kind != "purchase", F.col("text")).alias("text"), "vec_id", "embedding_model",
        F.when(kind == "error", "many").otherwise(F.col("embedding_dim").cast("string")).alias("embedding_dim"),
        F.col("trans_id").alias("seq"), F.when(kind == "click", "calm").alias("mood"))
    line = F.when(kind == "signup", F.concat(F.lit("{broken "), F.to_json(fields))).otherwise(F.to_json(fields))
    rows = I.json_records(m.select(line.alias("value")))
    accepted, rejected = I.check_batch(rows, unknown_col="_unknown", corrupt_col="_corrupt")
    keep = ["trans_id", "timestamp", "speaker"]
    return as_ntz(accepted.select(*keep, F.lit("accepted").alias("outcome")).unionByName(
        rejected.select(*keep, F.col("reject_reason").alias("outcome"))))
