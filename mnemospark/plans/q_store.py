"""Registered store, export and vector-format queries
(S1, S3, S4, S6, S7, S13-S16, A4, A7, C3, P3-P5, P10).

Queries that write use a fresh folder under the session's shared
checkpoint folder (``session.work_dir``) and read the result back.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import integrity as I
from ..operators import profile as PR
from ..schema import LONG_TERM_CHUNK_SECONDS, SHORT_TERM_CHUNK_SECONDS
from ..session import work_dir
from ..sources import csv_io
from ..sources import store as ST
from ..sources.export import export_run, read_run
from ..sources.tables import as_ntz, messages, table
from .common import SQL_MESSAGES_CTE, r6
from .q_ingest import _SQL_BATCH, fault_batch
from .registry import register

MODEL, DIM = "testdata-64", 64


def _stamped(spark, sf_dir):
    return I.stamp_provenance(messages(spark, sf_dir), MODEL, DIM, "diskann", "vector_cosine_ops")


def _vsum(col):
    return F.aggregate(col, F.lit(0.0).cast("double"), lambda acc, x: acc + F.coalesce(x.cast("double"), F.lit(0.0)))


@register("chunk_assign", "S14", f"""
with {SQL_MESSAGES_CTE}
select trans_id, cast(floor(epoch_us(timestamp) / {SHORT_TERM_CHUNK_SECONDS * 1_000_000}) as bigint) as chunk_short,
       cast(floor(epoch_us(timestamp) / {LONG_TERM_CHUNK_SECONDS * 1_000_000}) as bigint) as chunk_long
from messages
""")
def chunk_assign(spark, sf_dir):
    m = messages(spark, sf_dir)
    return m.select("trans_id", ST.chunk_of("timestamp", SHORT_TERM_CHUNK_SECONDS).alias("chunk_short"),
                    ST.chunk_of("timestamp", LONG_TERM_CHUNK_SECONDS).alias("chunk_long"))


@register("chunk_catalog", "A4", f"""
with {SQL_MESSAGES_CTE}
select cast(floor(epoch_us(timestamp) / {SHORT_TERM_CHUNK_SECONDS * 1_000_000}) as bigint) as chunk,
       min(timestamp) as first_ts, max(timestamp) as last_ts, count(*) as rows
from messages group by 1
""")
def chunk_catalog(spark, sf_dir):
    m = ST.prepare(messages(spark, sf_dir), "s", SHORT_TERM_CHUNK_SECONDS)
    return as_ntz(PR.chunk_catalog(m))


@register("csv_roundtrip", ("S1", "S3", "S4", "P4", "P5"), f"""
with {SQL_MESSAGES_CTE}
select trans_id, timestamp, speaker, text, len(embedding) as emb_len,
       round(list_sum(embedding::DOUBLE[]), 6) as emb_sum from messages
""")
def csv_roundtrip(spark, sf_dir):
    path = work_dir(spark, "csv") + "/messages.csv"
    csv_io.write_csv(_stamped(spark, sf_dir), path, mode="errorifexists", compression="gzip")
    back = csv_io.read_csv(spark, path)
    return as_ntz(back.select("trans_id", "timestamp", "speaker", "text", F.size("embedding").cast("long").alias("emb_len"),
                              r6(_vsum(F.col("embedding"))).alias("emb_sum")))


LOAD_ROWS = 1000  # rows of one load chunk


@register("csv_arrival", ("S1", "S2", "S4"), f"""
with {SQL_MESSAGES_CTE}, n as (select *, row_number() over (order by trans_id) - 1 as seq from messages)
select trans_id, seq, seq // {LOAD_ROWS} as batch_id, ' ' || speaker || chr(10) || text || chr(92) || 'n' as text
from n
""")
def csv_arrival(spark, sf_dir):
    """Files in the order of the ids, in the line-safe form, with texts of
    several lines; arrival numbers and load chunks follow that order."""
    path = work_dir(spark, "csv") + "/in"
    rows = _stamped(spark, sf_dir).withColumn("text", F.concat(F.lit(" "), "speaker", F.lit("\n"), "text", F.lit("\\n")))
    csv_io.write_csv(rows.repartitionByRange("trans_id").sortWithinPartitions("trans_id"), path,
                     mode="errorifexists", line_safe=True)
    # Checked with the rows (``_corrupt``), but not carried: no output names it.
    back = csv_io.with_arrival(csv_io.read_csv(spark, path, line_safe=True).drop("embedding"))
    return back.select("trans_id", "seq", F.floor(F.col("seq") / LOAD_ROWS).alias("batch_id"), "text")


@register("export_gzip", ("S6", "S16"), f"""
with {SQL_MESSAGES_CTE}
select speaker, count(*) as rows, count(distinct vec_id) as vectors from messages group by speaker
""")
def export_gzip(spark, sf_dir):
    path = work_dir(spark, "export") + "/transcriptionsvectors"
    csv_io.write_csv(_stamped(spark, sf_dir), path, mode="errorifexists", compression="gzip")
    back = csv_io.read_csv(spark, path)
    return back.groupBy("speaker").agg(F.count(F.lit(1)).alias("rows"),
                                       F.countDistinct("vec_id").alias("vectors"))


EXPORT_DAY = dt.date(2024, 2, 1)


@register("export_append", ("S5", "S4", "P21", "A1"), f"""
with {SQL_MESSAGES_CTE}
select 'messages_{EXPORT_DAY}' as name, case when trans_id % 2 = 0 then 1 else 2 end as run, trans_id, speaker, text
from messages
union all
select 'messages_{EXPORT_DAY}', 2, trans_id, speaker, text from messages where trans_id % 4 = 0
""")
def export_append(spark, sf_dir):
    """Two numbered runs of one export and, a day later, one append to the
    newer run that is tried twice; the name gets the date it lacks."""
    root, rows = work_dir(spark, "runs"), _stamped(spark, sf_dir)
    paths = [export_run(rows.filter(part), root, "messages", EXPORT_DAY)
             for part in ("trans_id % 2 = 0", "trans_id % 2 <> 0")]
    later = EXPORT_DAY + dt.timedelta(days=1)
    paths.append(export_run(rows.filter("trans_id % 4 = 0"), root, "messages", later, auto_increment=False, batch_id="b0"))
    paths.append(export_run(rows.filter("trans_id % 4 = 0"), root, "messages", later, batch_id="b0", run=2))
    out = None
    for path in sorted(set(paths)):
        part = read_run(spark, path).select(
            X.append_date(F.lit("messages"), F.lit(EXPORT_DAY)).alias("name"),
            F.lit(int(path.rsplit("=", 1)[1])).alias("run"), "trans_id", "speaker", "text")
        out = part if out is None else out.unionByName(part)
    return out


@register("snapshot_manifest", ("S7", "S16"), f"""
with {SQL_MESSAGES_CTE}
select count(*) as rows, min(timestamp) as first_ts, max(timestamp) as last_ts, true as restored_equal
from messages
""")
def snapshot_manifest(spark, sf_dir):
    root = work_dir(spark, "store")
    store = ST.MessageStore(spark, root, LONG_TERM_CHUNK_SECONDS, MODEL, DIM)
    rows = ST.prepare(_stamped(spark, sf_dir).withColumn("seq", F.col("trans_id")), "s0", LONG_TERM_CHUNK_SECONDS)
    store.put(rows)
    snap = store.snapshot(root + "_snapshot", codec="zstd")
    live = ST.manifest(store.read())
    restored = spark.read.parquet(root + "_snapshot")
    return as_ntz(restored.agg(F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first_ts"),
                               F.max("timestamp").alias("last_ts"))
                  .withColumn("restored_equal", F.lit(snap == live)))


RESET_DAY = "2024-01-15"


@register("session_reset", ("S13", "S15", "S8"), f"""
with {SQL_MESSAGES_CTE}
select trans_id, 'day-' || strftime(timestamp, '%Y-%m-%d') as session_id from messages
where strftime(timestamp, '%Y-%m-%d') <> '{RESET_DAY}'
""")
def session_reset(spark, sf_dir):
    root = work_dir(spark, "store")
    store = ST.MessageStore(spark, root, LONG_TERM_CHUNK_SECONDS, MODEL, DIM)
    rows = _stamped(spark, sf_dir).withColumn("seq", F.col("trans_id"))
    sid = F.concat(F.lit("day-"), F.date_format("timestamp", "yyyy-MM-dd"))
    prepared = ST.prepare(rows, sid, LONG_TERM_CHUNK_SECONDS)
    store.put(prepared)
    store.snapshot(root + "_snapshot")
    store.reset(F.col("session_id") != f"day-{RESET_DAY}", root + "_snapshot")
    return store.read().select("trans_id", "session_id")


@register("parse_vectors", ("P4", "P5", "C3"), """
select vec_id, len(embedding) + case when label = 3 then 1 else 0 end as n,
       case when label = 3 then 1 else 0 end as n_bad, label <> 3 as valid,
       round(list_sum(embedding::DOUBLE[]), 6) as total
from embeddings
""")
def parse_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    txt = V.vector_to_text("embedding")
    txt = F.when(F.col("label") == 3, F.concat(F.lit("[x, "), F.substring(txt, 2, 1 << 30))).otherwise(txt)
    p = e.select("vec_id", txt.alias("t")).select("vec_id", "t", V.parse_vector("t", "float").alias("v"))
    return p.select("vec_id", F.size("v").cast("long").alias("n"),
                    F.size(F.filter("v", lambda x: x.isNull())).alias("n_bad"),
                    V.vector_is_valid("t").alias("valid"), r6(_vsum(F.col("v"))).alias("total"))


@register("normalize_vectors", "P10", """
with s as (select vec_id, list_transform(embedding, lambda x: (x::DOUBLE * label)::FLOAT) as v from embeddings),
n as (select vec_id, v, sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[])) as nb from s)
select vec_id, round(nb, 6) as norm_before,
       case when nb = 0 then null else round(((v[1]::DOUBLE / nb)::FLOAT)::DOUBLE, 6) end as first,
       case when nb = 0 then null
            else round(sqrt(list_sum(list_transform(v, lambda x: ((x::DOUBLE / nb)::FLOAT)::DOUBLE
                                                                * ((x::DOUBLE / nb)::FLOAT)::DOUBLE))), 6) end
         as norm_after
from n
""")
def normalize_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    s = e.select("vec_id", F.transform("embedding", lambda x: (x.cast("double") * F.col("label")).cast("float"))
                 .alias("v"))
    n = s.select("vec_id", V.norm("v").alias("nb"), V.l2_normalize("v").alias("u"))
    return n.select("vec_id", r6("nb").alias("norm_before"), r6(F.col("u")[0].cast("double")).alias("first"),
                    r6(V.norm("u")).alias("norm_after"))


@register("dim_audit", ("A7", "C3", "P3"), f"""
with {_SQL_BATCH}
select embedding_model, len(embedding) as dim, count(*) as rows,
       count(*) filter (where embedding is not null and len(embedding) <> embedding_dim) as mismatched
from batch group by all
""")
def dim_audit(spark, sf_dir):
    return PR.dim_audit(fault_batch(spark, sf_dir))


@register("writer_hook", ("S17", "S9"), f"""
with {SQL_MESSAGES_CTE}
select 'store' as sink, trans_id, timestamp, speaker, text from messages
union all
select 'copy', trans_id, timestamp, speaker, text from messages where speaker <> 'user_0'
""")
def writer_hook(spark, sf_dir):
    """A user's bulk writer in place of the store's own: it writes the rows
    with a codec of its choice and keeps a copy without one speaker."""
    root = work_dir(spark, "writer-hook")

    def bulk(rows, path, mode):
        rows.write.mode(mode).option("compression", "zstd").partitionBy("session_id", "chunk").parquet(path)
        rows.filter("speaker <> 'user_0'").write.mode(mode).parquet(f"{root}/copy")

    store = ST.MessageStore(spark, f"{root}/store", LONG_TERM_CHUNK_SECONDS, MODEL, DIM)
    store.append(_stamped(spark, sf_dir).withColumn("seq", F.col("trans_id")), "s0", writer=bulk)
    part = lambda name, df: df.select(F.lit(name).alias("sink"), "trans_id", "timestamp", "speaker", "text")
    return as_ntz(part("store", store.read()).unionByName(part("copy", spark.read.parquet(f"{root}/copy"))))
