"""Registered keyword, ad-hoc SQL, profile and page queries
(K7-K9, F5, F6, A5, P25, M4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adhoc as AD
from ..operators import keyword as KW
from ..operators import pages as PG
from ..operators import profile as PR
from ..operators import sketches as SK
from ..session import work_dir
from ..sources.tables import messages, table
from .common import PROBE_VEC_ID, SQL_DIST, SQL_MESSAGES_CTE
from .registry import register

# Fixed query text of the keyword searches.
KEYWORD_QUERY = "ouier réeaution thanedble erstlyat"


def _sql_terms() -> str:
    return ", ".join(f"'{t}'" for t in KW.query_terms(KEYWORD_QUERY))


_SQL_BM25 = f"""
d as (select page_id, html,
             list_filter(regexp_split_to_array(lower(regexp_replace(html, '<[^>]*>', ' ', 'g')), '[^\\p{{L}}\\p{{N}}]+'),
                         lambda x: x <> '') as t
      from pages),
s as (select count(*) as n, avg(len(t)) as avgdl from d),
h as (select page_id, len(t) as dl, unnest(t) as term from d),
tf as (select page_id, dl, term, count(*) as tf from h where term in ({_sql_terms()}) group by all),
dfq as (select term, count(*) as df from tf group by term),
sc as (select tf.page_id,
              sum(ln(1 + (s.n - dfq.df + 0.5) / (dfq.df + 0.5)) * tf.tf * {KW.BM25_K1 + 1}
                  / (tf.tf + {KW.BM25_K1} * ({1 - KW.BM25_B} + {KW.BM25_B} * tf.dl / s.avgdl))) as score
       from tf join dfq using (term), s group by tf.page_id),
top as (select page_id, score from sc order by score desc, page_id limit 3)
"""


@register("keyword_topk", "K7", f"""
with {_SQL_BM25}
select page_id, round(score, 6) as score from top
""")
def keyword_topk(spark, sf_dir):
    top = KW.bm25_top_k(table(spark, sf_dir, "pages"), "page_id", "html", KEYWORD_QUERY, k=3, html=True)
    return top.select("page_id", F.round("score", 6).alias("score"))


@register("snippet_topk", "K9", f"""
with {_SQL_BM25},
x as (select top.page_id, top.score, regexp_replace(p.html, '<[^>]*>', ' ', 'g') as txt
      from top join pages p on p.page_id = top.page_id),
y as (select *, list_min(list_filter([{", ".join(f"instr(lower(txt), '{t}')" for t in KW.query_terms(KEYWORD_QUERY))}],
                                     lambda v: v > 0)) as pos from x)
select page_id, round(score, 6) as score, coalesce(pos, 0) as first_hit,
       substring(txt, greatest(coalesce(pos, 1) - {KW.SNIPPET_BEFORE}, 1), {KW.SNIPPET_CHARS}) as snippet
from y
""")
def snippet_topk(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    top = KW.bm25_top_k(p, "page_id", "html", KEYWORD_QUERY, k=3, html=True)
    sn = KW.snippets(top, p, "page_id", "html", KEYWORD_QUERY, html=True)
    return sn.select("page_id", F.round("score", 6).alias("score"), "first_hit", "snippet")


# Fixed: queries put to one stored index.
INDEX_QUERIES = [KEYWORD_QUERY, "thanedble", "que la erst", "nowheretobefound ouier"]


def _index(spark, sf_dir):
    """The pages indexed in two parts, one of them twice."""
    p = table(spark, sf_dir, "pages")
    index = KW.Postings(spark, work_dir(spark, "postings"), "page_id", buckets=8)
    for part in ("0", "1", "0"):
        index.add(p.filter(F.col("page_id") % 2 == int(part)), "html", part, html=True)
    return p, index


def _sql_index_search(terms: list[str], rows: str) -> str:
    named = ", ".join(f"'{t}'" for t in terms)
    body = _SQL_BM25.replace(_sql_terms(), named)
    return f"select * from (with {body} {rows})"


@register("postings_topk", "K7", "\nunion all\n".join(_sql_index_search(
    KW.query_terms(q), f"select {i} as query, page_id, round(score, 6) as score from top") for i, q in enumerate(INDEX_QUERIES)))
def postings_topk(spark, sf_dir):
    """Several searches of one stored index."""
    _, index = _index(spark, sf_dir)
    out = None
    for i, q in enumerate(INDEX_QUERIES):
        top = index.top_k(q).select(F.lit(i).alias("query"), "page_id", F.round("score", 6).alias("score"))
        out = top if out is None else out.unionByName(top)
    return out


ADHOC_SQL = f"""
SELECT speaker, count(*) AS n,
       round(min(cosine_distance(embedding, (SELECT embedding FROM embeddings WHERE vec_id = {PROBE_VEC_ID}))), 6)
         AS best
FROM messages
GROUP BY speaker
"""


@register("adhoc_sql", ("K8", "F6", "P6"), f"""
with {SQL_MESSAGES_CTE}, q as (select embedding from embeddings where vec_id = {PROBE_VEC_ID})
select speaker, count(*) as n, round(min({SQL_DIST['cosine']('m.embedding', 'q.embedding')}), 6) as best
from messages m, q group by speaker
""")
def adhoc_sql(spark, sf_dir):
    views = {"messages": messages(spark, sf_dir), "embeddings": table(spark, sf_dir, "embeddings")}
    return AD.run_readonly_sql(spark, ADHOC_SQL, views)


# Fixed: queries over the one view ``messages``, with the rows they give or
# None where they must be refused.
GUARDED = [
    ("SELECT trans_id FROM messages", "select count(*) from messages"),
    ("SELECT speaker FROM IDENTIFIER('messages') GROUP BY speaker", "select count(distinct speaker) from messages"),
    ("WITH w AS (SELECT DISTINCT text FROM messages) SELECT * FROM w", "select count(distinct text) from messages"),
    ("SELECT * FROM embeddings", None),
    ("SELECT * FROM IDENTIFIER('embeddings')", None),
    ("WITH embeddings AS (SELECT * FROM embeddings) SELECT * FROM embeddings", None),
    ("SELECT (SELECT count(*) FROM embeddings) AS n FROM messages", None),
    ("SELECT IDENTIFIER('java_method')('java.lang.System', 'lineSeparator') AS x FROM messages", None),
    ("DELETE FROM messages", None),
    ("SELECT 1; DROP VIEW messages", None),
]


@register("adhoc_guard", ("F5", "F6", "K8"), f"""
with {SQL_MESSAGES_CTE}
""" + "\nunion all\n".join(
    f"select {i} as number, {'true' if sql is None else 'false'} as refused, "
    f"{'cast(null as bigint)' if sql is None else f'({sql})'} as rows" for i, (_, sql) in enumerate(GUARDED)))
def adhoc_guard(spark, sf_dir):
    """Which texts run, with their rows, when only ``messages`` is given and
    the caller's session holds ``embeddings`` too."""
    views = {"messages": messages(spark, sf_dir)}
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("embeddings")
    try:
        out = []
        for i, (text, _) in enumerate(GUARDED):
            try:
                out.append((i, False, AD.run_readonly_sql(spark, text, views).count()))
            except AD.ReadOnlyError:
                out.append((i, True, None))
    finally:
        spark.catalog.dropTempView("embeddings")
    return spark.createDataFrame(out, "number int, refused boolean, rows long")


# Fixed: the given tables with their declared types and keys.
PROFILED = {
    "region": ("r_regionkey int, r_name string", "r_regionkey"),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", "n_nationkey"),
    "customer": ("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", "c_custkey"),
    "supplier": ("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", "s_suppkey"),
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
             "p_partkey"),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string", "o_orderkey"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                 "l_linestatus string, l_shipdate timestamp_ntz", "l_orderkey, l_linenumber"),
    "events": ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
               "event_id"),
    "documents": ("doc_id bigint, text string, lang string, source string, n_chars bigint", "doc_id"),
    "embeddings": ("vec_id bigint, embedding array<float>, label int", "vec_id"),
    "pages": ("page_id bigint, url string, html string", "page_id"),
    "benchmark": ("item_id bigint, text string", "item_id"),
    "labels": ("doc_id bigint, quality int, toxic int", "doc_id"),
    "conversations": ("conv_id bigint, turn bigint, role string, text string", "conv_id, turn"),
}
#: Types whose least and greatest value have one text form.
_PLAIN = ("int", "bigint", "string")


def _declared(name: str) -> tuple[list[tuple[str, str]], list[str]]:
    columns, key = PROFILED[name]
    return [tuple(c.split(" ", 1)) for c in columns.split(", ")], key.split(", ")


def _unique_sql(name: str, key: list[str]) -> str:
    return f"(select count(*) = count(distinct ({', '.join(key)})) from {name})"


def _profile_sql() -> str:
    parts = []
    for t in PROFILED:
        cols, key = _declared(t)
        for i, (c, typ) in enumerate(cols):
            ends = [f"cast({f}({c}) as varchar)" if typ in _PLAIN else "cast(null as varchar)" for f in ("min", "max")]
            parts.append(
                f"select '{t}' as table_name, {i} as position, '{c}' as column_name, '{typ}' as data_type, "
                f"count(*) - count({c}) as null_count, count(*) as rows, {ends[0]} as min_value, "
                f"{ends[1]} as max_value, '{'pk' if c in key else ''}' as keys, "
                f"{_unique_sql(t, key) if c in key else 'cast(null as boolean)'} as keys_unique from {t}")
    return "\nunion all\n".join(parts)


def _profiles(spark, sf_dir):
    return PR.profile_all({t: table(spark, sf_dir, t) for t in PROFILED},
                          {t: {"pk": _declared(t)[1]} for t in PROFILED})


@register("table_profile", "A5", _profile_sql())
def table_profile(spark, sf_dir):
    plain = F.col("data_type").isin(*_PLAIN)
    return _profiles(spark, sf_dir).select(
        "table_name", "position", "column_name", "data_type", "null_count", "rows",
        F.when(plain, F.col("min_value")).alias("min_value"), F.when(plain, F.col("max_value")).alias("max_value"),
        "keys", "keys_unique")


def _json_sql() -> str:
    parts = []
    for t in PROFILED:
        cols, key = _declared(t)
        texts = []
        for i, (c, typ) in enumerate(cols):
            text = (f'{{"position":{i},"c":{{"column_name":"{c}","data_type":"{typ}","nullable":true,'
                    f'"keys":"{"pk" if c in key else ""}"')
            texts.append(f"'{text},\"keys_unique\":' || {_unique_sql(t, key)} || '}}}}'" if c in key else f"'{text}}}}}'")
        parts.append(f"select '{t}' as table_name, '[' || " + " || ',' || ".join(texts) + " || ']' as description")
    return "\nunion all\n".join(parts)


@register("table_json", ("P25", "A5"), _json_sql())
def table_json(spark, sf_dir):
    return PR.describe_json(_profiles(spark, sf_dir)).withColumnRenamed("_j", "description")


#: Distinct counts that a sketch gives exactly.
EXACT_DISTINCT = 100
SKETCH_RANGE = ("2024-01-08", "2024-01-21")


def _sketch_sql() -> str:
    parts = []
    for scope, where in (("all", "true"), ("range", "strftime(ts, '%Y-%m-%d') between '{}' and '{}'".format(*SKETCH_RANGE))):
        for i, (c, typ) in enumerate(_declared("events")[0]):
            ends = [f"cast({f}({c}) as varchar)" if typ in _PLAIN else "cast(null as varchar)" for f in ("min", "max")]
            counted = f"count({c})" if typ in ("bigint", "double") else "cast(null as bigint)"
            parts.append(f"select '{scope}' as scope, {i} as position, '{c}' as column_name, '{typ}' as data_type, "
                         f"count(*) as rows, count(*) - count({c}) as null_count, {ends[0]} as min_value, "
                         f"{ends[1]} as max_value, {counted} as counted, case when count(distinct {c}) <= {EXACT_DISTINCT} "
                         f"then count(distinct {c}) end as small_distinct from events where {where}")
    return "\nunion all\n".join(parts)


@register("sketch_profile", "A5", _sketch_sql())
def sketch_profile(spark, sf_dir):
    """Events stored by day in three batches, one of them twice; the profile
    of all days and of two weeks from the stored sketches."""
    events = table(spark, sf_dir, "events").withColumn("_day", F.date_format("ts", "yyyy-MM-dd"))
    store = SK.ProfileStore(spark, work_dir(spark, "sketches"))
    for part in (0, 1, 2, 1):
        store.put(events.filter(F.dayofmonth("ts") % 3 == part), "_day")
    plain = F.col("data_type").isin(*_PLAIN)
    out = None
    for scope, bounds in (("all", ()), ("range", SKETCH_RANGE)):
        got = store.profile(*bounds).select(
            F.lit(scope).alias("scope"), "position", "column_name", "data_type", "rows", "null_count",
            F.when(plain, F.col("min_value")).alias("min_value"), F.when(plain, F.col("max_value")).alias("max_value"),
            "counted", F.when(F.col("distinct_estimate") <= EXACT_DISTINCT, F.col("distinct_estimate")).alias("small_distinct"))
        out = got if out is None else out.unionByName(got)
    return out


_LETTER = r"[\p{L}\p{Nl}\p{No}_]"
_HYPHEN = rf"(?:{_LETTER}{_LETTER}-|{_LETTER}-{_LETTER}-)"
_W = PG.PAGE_WIDTH


def _sql_pages() -> str:
    """Page by page; the last place up to the width is a space, or a hyphen
    that letters follow, else the word is cut.  Dashes between words and
    hyphens in words longer than a page, which the tables lack, are left to
    the tests."""
    def hyphen(after: str, size: int) -> str:
        return f"length(regexp_extract(substring(rest, 1, {_W + size}), '(?s)^(.*{_HYPHEN}){after}', 1))"
    return f"""
with recursive flat as (
  select doc_id, text, translate(array_to_string(list_transform(string_split(text, chr(9)), lambda p, i:
           case when i = len(string_split(text, chr(9))) then p
                else p || repeat(' ', {PG.TAB} - length(regexp_extract(p, '[^\n\r]*$')) % {PG.TAB}) end), ''),
         chr(10) || chr(11) || chr(12) || chr(13), '    ') as t
  from documents where length(text) > {_W}),
cut(doc_id, page, text, rest) as (
  select doc_id, 0, '', t from flat
  union all
  select doc_id, page + 1, rtrim(substring(rest, 1, stop)), ltrim(substring(rest, stop + 1))
  from (select *, case when length(rest) <= {_W} then {_W}
                       when greatest(space, h2, h3) > 0 then greatest(space, h2, h3) else {_W} end as stop
        from (select doc_id, page, rest, {hyphen(_LETTER + _LETTER, 2)} as h2, {hyphen(_LETTER + '-' + _LETTER, 3)} as h3,
                     case when instr(reverse(substring(rest, 1, {_W + 1})), ' ') = 0 then 0
                          else {_W + 1} - instr(reverse(substring(rest, 1, {_W + 1})), ' ') end as space
              from cut where rest <> ''))),
paged as (
  select doc_id, page, max(page) over (partition by doc_id) as pages, text from cut where page > 0
  union all
  select doc_id, 1, 1, text from documents where length(text) <= {_W})
select doc_id, page, pages, length(text) as page_chars, length(message) as message_chars, md5(message) as message_md5
from (select *, case when pages > 1 then 'Page ' || page || '/' || pages || ': ' else '' end || '@user ' || text as message
      from paged)
"""


@register("wrap_pages", ("M4", "P14"), _sql_pages())
def wrap_pages(spark, sf_dir):
    """Every document as numbered messages of at most a page."""
    d = table(spark, sf_dir, "documents")
    pg = PG.page_messages(PG.pages(d, "doc_id", "text"), "@user")
    return pg.select("doc_id", "page", "pages", F.length("text").alias("page_chars"),
                     F.length("message").alias("message_chars"), F.md5("message").alias("message_md5"))
