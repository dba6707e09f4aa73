"""Registered text, name and id queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import inventory as INV
from ..sources.tables import FILE_LISTING_SQL, file_listing, messages, table
from .common import SQL_MESSAGES_CTE
from .registry import register


@register("instruct_prefix", "P11", f"""
select conv_id, turn, 'Instruct: ' || '{X.DEFAULT_TASK}' || chr(10) || 'Query: ' || text as query_text
from conversations where role = 'user'
""")
def instruct_prefix(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.filter(F.col("role") == "user").select("conv_id", "turn", X.instruct("text").alias("query_text"))


@register("strip_think", "P12", """
select conv_id, turn,
       regexp_replace('<think>' || role || chr(10) || cast(turn as varchar) || '</think>' || text || '<think>x</think>',
                      '<think>.*?</think>', '', 'gs') as cleaned
from conversations
""")
def strip_think(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    raw = F.concat(F.lit("<think>"), F.col("role"), F.lit("\n"), F.col("turn").cast("string"), F.lit("</think>"),
                   F.col("text"), F.lit("<think>x</think>"))
    return c.select("conv_id", "turn", X.strip_think(raw).alias("cleaned"))


@register("preview", "P13", """
select doc_id, substring(text, 1, 100) as preview, length(text) as n_chars from documents
""")
def preview(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.preview("text").alias("preview"), F.length("text").cast("long").alias("n_chars"))


@register("formatted", ("P14", "P15"), f"""
with {SQL_MESSAGES_CTE}
select trans_id, speaker || ': ' || text as line,
       strftime(timestamp, '%Y-%m-%d %H:%M:%S') || ': ' || text as timed,
       '**Input**: ' || text || ' ' || chr(10) || chr(10) || 'noted, ' || speaker as reply
from messages
""")
def formatted(spark, sf_dir):
    m = messages(spark, sf_dir)
    return m.select("trans_id", X.speaker_line("speaker", "text").alias("line"),
                    X.timed_text("timestamp", "text").alias("timed"),
                    X.input_reply("text", F.concat(F.lit("noted, "), F.col("speaker"))).alias("reply"))


_SQL_NAMES = f"""
n as (select 'page' as kind, page_id as id, regexp_extract(url, '[^/]*$', 0) as name from pages
      union all
      select 'file', doc_id, path from ({FILE_LISTING_SQL}))
"""


def _sql_valid(x: str) -> str:
    stem = (f"case when regexp_replace({x}, '^\\.+', '') like '%.%' "
            f"then regexp_extract({x}, '^(.*)\\.[^.]*$', 1) else {x} end")
    reserved = ", ".join(f"'{r}'" for r in X.RESERVED_NAMES)
    return (f"coalesce(length({x}) > 0 and not {x} like '% ' and not {x} like '%.' "
            f"and upper({stem}) not in ({reserved}) "
            f"and not regexp_matches({x}, '[<>:\"/\\\\|?*]'), false)")


@register("filename_audit", ("P23", "P24"), f"""
with {_SQL_NAMES},
t as (select kind, id, name, trim(name, ' ') as tn from n),
s as (select kind, id, name,
        case when regexp_replace(tn, '^\\.+', '') like '%.%' then regexp_extract(tn, '^(.*)\\.[^.]*$', 1)
             else tn end as tstem,
        case when regexp_replace(tn, '^\\.+', '') like '%.%' then regexp_extract(tn, '(\\.[^.]*)$', 1)
             else '' end as text_
      from t)
select kind, id, name, {_sql_valid('name')} as valid,
       case when {_sql_valid('tstem')}
            then tstem || case when lower(text_) = '.csv' then text_ else '.csv' end end as csv_name
from s
""")
def filename_audit(spark, sf_dir):
    """File names from whole fields: the last URL segment of every page and
    every exported file name of the listing."""
    pages = table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"),
        F.regexp_extract("url", "[^/]*$", 0).alias("name"))
    files = file_listing(spark, sf_dir).select(F.lit("file").alias("kind"), F.col("doc_id").alias("id"),
                                               F.col("path").alias("name"))
    names = pages.unionByName(files)
    return names.select("kind", "id", "name", X.valid_file_name("name").alias("valid"),
                        X.force_extension("name", "csv").alias("csv_name"))


@register("export_runs", ("S5", "A1", "P21", "P22"), f"""
with l as ({FILE_LISTING_SQL}),
p as (select regexp_extract(path, '^(.*)\\.[^.]*$', 1) as stem, regexp_extract(path, '(\\.[^.]*)$', 1) as ext from l),
q as (select case when regexp_matches(stem, '_[0-9]+$') then regexp_extract(stem, '^(.*)_[0-9]+$', 1) else stem end as base,
             ext,
             case when regexp_matches(stem, '_[0-9]+$') then cast(regexp_extract(stem, '_([0-9]+)$', 1) as bigint) end as num
      from p)
select base, ext, max(num) as last_run, max(num) + 1 as next_run, count(*) as files,
       case when regexp_matches(base, '\\d{{4}}-\\d{{2}}-\\d{{2}}') then base
            else base || '_' || '2024-02-01' end as dated_base
from q where num is not null group by base, ext
""")
def export_runs(spark, sf_dir):
    runs, _ = INV.file_numbers(file_listing(spark, sf_dir), "path")
    return runs.select("base", "ext", "last_run", "next_run", "files",
                       X.append_date("base", F.lit("2024-02-01").cast("date")).alias("dated_base"))


ID_EPOCH = "2020-01-01 00:00:00"  # fixed: our id layout's epoch (UTC)


@register("ordered_ids", "P16", f"""
select event_id,
  ((epoch_us(ts) - epoch_us(TIMESTAMP '{ID_EPOCH}')) // 10000) * 16777216
  + row_number() over (partition by (epoch_us(ts) - epoch_us(TIMESTAMP '{ID_EPOCH}')) // 10000 order by event_id) - 1
  as msg_id
from events
""")
def ordered_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return INV.time_ordered_ids(e, "ts", "event_id", ID_EPOCH).select("event_id", "msg_id")


@register("merge_maps", "P20", """
select event_id, cast(user_id as varchar) as k, event_type as kind,
       cast(json_extract_string(props, '$.k') as varchar) as old_k, 2 as n_keys
from events
""")
def merge_maps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    old = F.from_json("props", "map<string,string>")
    new = F.create_map(F.lit("k"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"))
    merged = F.map_concat(old, new)
    return e.select("event_id", merged["k"].alias("k"), merged["kind"].alias("kind"),
                    old["k"].alias("old_k"), F.size(merged).alias("n_keys"))



