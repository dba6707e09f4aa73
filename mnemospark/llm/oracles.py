"""DuckDB SQL of the queries that SQL can state."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string: each byte is folded in, then eight shifts."""
    steps = ", ".join(["-1"] * 8)
    items = f"[4294967295::bigint] || flatten([[ord(({text})[i])::bigint, {steps}] for i in range(1, length({text}) + 1)])"
    return (f"xor(list_reduce({items}, lambda acc, x: case when x >= 0 then xor(acc, x) "
            "when acc % 2 = 1 then xor(acc >> 1, 3988292384) else acc >> 1 end), 4294967295)")


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::varchar) || ':' || {column}::varchar, '-')"


def _leaf(text: str = "text") -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, key: str, start: str) -> str:
    """The levels of a tree for each ``key`` until one node is left, and each
    node's siblings to the left and right in its run of three."""
    return f"""{name}(k, lvl, p, h, n) as (
  {start}
  union all
  select k, lvl + 1, p // 3, sha256(string_agg(h, '' order by p)), (n + 2) // 3
  from {name} where n > 1 group by k, lvl, p // 3, n
),
{name}_path as (
  select a.k, a.lvl, a.p,
    coalesce(string_agg(b.h, '' order by b.p) filter (b.p < a.p), '') as l,
    coalesce(string_agg(b.h, '' order by b.p) filter (b.p > a.p), '') as r
  from {name} a join {name} b on a.k is not distinct from b.k and a.lvl = b.lvl and a.p // 3 = b.p // 3
  where a.n > 1 group by a.k, a.lvl, a.p
)"""


MANIFEST_SQL = f"""
with recursive rows_ as (
  select doc_id, source, {_leaf()} as leaf,
    case when doc_id is not null and ({_crc32("doc_id::varchar")}) % 2 = 0
      then {_leaf("replace(text, chr(10), '')")} else {_leaf()} end as given
  from documents
),
leaves as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as p,
    count(*) over (partition by source) as n from rows_
),
{_tree("tree", "source", "select source, 0, p, leaf, n from leaves")},
subroots as (
  select k, h, row_number() over (order by k nulls first) - 1 as p, count(*) over () as n from tree where n = 1
),
{_tree("top_", "0", "select 0, 0, p, h, n from subroots")},
steps as (
  select d.doc_id, d.source, d.p as at_, 0 as tier, t.lvl, t.l, t.r
  from leaves d join tree_path t on t.k is not distinct from d.source and t.p = d.p // (3 ** t.lvl)::bigint
  union all
  select d.doc_id, d.source, d.p, 1, t.lvl, t.l, t.r
  from leaves d join subroots s on s.k is not distinct from d.source
  join top__path t on t.p = s.p // (3 ** t.lvl)::bigint
),
proofs as (
  select source, at_, string_agg(l || r, '' order by tier, lvl) as joined,
    list(l || '|' || r order by tier, lvl) as path from steps group by source, at_
)
select d.doc_id, d.leaf, s.h as subroot, (select h from top_ where n = 1) as root,
  sha256(coalesce(q.joined, '')) as proof_sha256,
  list_reduce([d.given] || coalesce(q.path, []), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2)))
    as folded_root,
  list_reduce([d.given] || coalesce(q.path, []), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2)))
    = (select h from top_ where n = 1) as verified
from leaves d join subroots s on s.k is not distinct from d.source
left join proofs q on q.source is not distinct from d.source and q.at_ = d.p
"""

MAXSCORE_SQL = """
with v as (
  select row_number() over () as r, vec_id, [floor(1024 * x::double)::bigint for x in embedding] as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
  select q.r as q, q.vec_id as query_id, c.vec_id, c.r as r,
    list_sum([a * b for a, b in list_zip(q.v, c.v)])::bigint as score
  from v q join v c on q.r <> c.r where q.vec_id % 100 = 0
),
ranked as (
  select *, row_number() over (partition by q order by score desc, vec_id, r) as rank from scored
)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 10
""".replace("[a * b for a, b in list_zip(q.v, c.v)]",
            "list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))")

REPAIR_SQL = rf"""
with recursive source_ as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key_ from conversations
),
hurt as (select *, ({_crc32("key_")}) % 20 as how from source_),
damaged as (
  select conv_id, turn, case when how = 4 then 'user' else role end as role,
    case when how = 1 then '' when how = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from hurt, (select unnest([1, 2]) as copy) where how <> 0 and (copy = 1 or how = 3)
),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as i from damaged
),
faults as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1
      when row_number() over (partition by conv_id, role, text order by i) > 1 then 2
      when regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) not in ('.', '!', '?') then 3 else 0 end as fault,
    lag(substr(role, 1, 1)) over (partition by conv_id order by i) || substr(role, 1, 1) as pair
  from placed
),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
    count(*) filter (fault = 3) as truncated,
    count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal, max(i) as n
  from faults group by conv_id
),
-- tops: 0 start, 1 after s, 2 after u, 3 after a
moves(a, letter, b) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
one as (select a, b, letter from moves where letter <> 's'),
ways as (
  select top as a, top as b, 0 as cost, '' as audit, '' as lines from (values (0), (1), (2), (3)) t(top)
  union all select a, b, 5, 'I', case letter when 'u' then 'user:' else 'assistant:' end || chr(10) from one
  union all select x.a, y.b, 10, 'II', case x.letter when 'u' then 'user:' || chr(10) || 'assistant:' || chr(10)
      else 'assistant:' || chr(10) || 'user:' || chr(10) end from one x join one y on x.b = y.a
),
heads(conv_id, i, top, best) as (
  select conv_id, 0::bigint, 0, {{'cost': 0::bigint, 'audit': '', 'lines': ''}} from counts
  union all
  select conv_id, i, top, min(best) from (
    select h.conv_id, f.i, e.top, {{'cost': h.best.cost + w.cost + e.cost, 'audit': h.best.audit || w.audit || e.letter,
      'lines': h.best.lines || w.lines || e.line}} as best
    from heads h join faults f on f.conv_id is not distinct from h.conv_id and f.i = h.i + 1
    join ways w on w.a = h.top,
    lateral (
      select w.b as top, 2 as cost, 'D' as letter, '' as line
      union all
      select m.b, case f.fault when 3 then 5 else 0 end, 'K', f.role || ':' || f.text || chr(10)
      from moves m where m.a = w.b and m.letter = substr(f.role, 1, 1) and f.fault in (0, 3)
      union all
      select m.b, case f.fault when 3 then 6 else 1 end, 'R',
        case m.letter when 'u' then 'user' else 'assistant' end || ':' || f.text || chr(10)
      from moves m where m.a = w.b and m.letter <> 's' and f.fault in (0, 3)
    ) e
  ) group by conv_id, i, top
),
ended as (
  select c.conv_id, min({{'cost': h.best.cost + w.cost, 'audit': h.best.audit || w.audit, 'lines': h.best.lines || w.lines}}) as best
  from counts c join heads h on h.conv_id is not distinct from c.conv_id and h.i = c.n
  join ways w on w.a = h.top where w.b in (0, 3) group by c.conv_id
),
every as (select distinct conv_id from conversations)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank,
  coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(b.best.cost, 0)::bigint as cost, coalesce(b.best.audit, '') as audit,
  sha256(coalesce(b.best.lines[:-2], '')) as repaired_sha256
from every e left join counts c on c.conv_id is not distinct from e.conv_id
left join ended b on b.conv_id is not distinct from e.conv_id
"""
