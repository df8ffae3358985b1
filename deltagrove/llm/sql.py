"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_WORD = r"[^\x20\x09-\x0D]+"

MIXING = rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::bigint as size from documents),
s as (select source, sum(size)::hugeint as ss, 1 + (row_number() over (order by source nulls last) - 1) % 3 as w from d group by source),
t as (select coalesce(sum(ss), 0)::hugeint as total from s),
o as (select s.*, row_number() over (order by 3.0 * ss / w, source nulls last) as k from s),
p as (select o.*, total - coalesce(sum(3 * ss) over (order by k rows between unbounded preceding and 1 preceding), 0) as rest,
             sum(w) over (order by k rows between current row and unbounded following) as wrest from o, t),
m as (select min(k) as k from p where 3 * ss * wrest >= rest * w),
z as (select rest as r, wrest as wr, p.k from p join m on p.k = m.k),
g as (select p.source, p.ss, case when z.k is null or p.k < z.k then (3 * p.ss)::double
             else r::double * p.w::double / wr::double end as target from p left join z on true),
h as (select *, case when ss > 0 then floor(target / ss)::bigint else 0 end as whole from g),
x as (select d.doc_id, d.size, h.ss::bigint as source_size, h.target, h.whole, floor(h.target + 0.5)::bigint - h.whole * h.ss as extra,
             sum(d.size) over (partition by d.source order by md5('mix' || coalesce(d.doc_id::varchar, '')), d.doc_id, d.size
                               rows between unbounded preceding and current row) - d.size as ahead
      from d join h on d.source is not distinct from h.source)
select doc_id, size, source_size, target, (whole * size + least(greatest(extra - ahead, 0), size))::bigint as taken from x
"""

_ESCAPED = r"regexp_replace({}, '([\\#<{}])', '\\\1', 'g')"

CHAT = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(4 + length({_ESCAPED.format("role", ":")}) + 2 + length({_ESCAPED.format("text", "")}) + 9)::bigint as formatted_chars
from c group by conv_id
"""

URLS = r"""
with a as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as h from a),
c as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from b),
r(rh, rp, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
j as (select page_id, max(struct_pack(n := length(rh || rp), rule := rh || rp, v := v)) as best
      from c join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id)
select c.page_id, host, path, best.rule as rule, coalesce(best.v, 'allow') as verdict from c left join j on c.page_id = j.page_id
"""

ORACLE = {"op3_mixing": MIXING, "op4_chat": CHAT, "op5_urls": URLS}
