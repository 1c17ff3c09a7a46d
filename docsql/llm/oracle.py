"""SQL that gives the same rows as queries of this subpackage, where SQL can say it."""

_ONE = "(select * from (select *, row_number() over (partition by id order by received_at desc) as rn from ingest_documents where id is not null) where rn = 1)"

P1_FOUND = rf"""
with one as (select d.id, case when o.size >= 1 then o.size else 1200 end as size,
    trim(replace(replace(d.content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ' || chr(9) || chr(10)) as t
  from {_ONE} d left join chunk_options o on d.collection = o.collection)
select id, case when list_max(list_transform(regexp_split_to_array(t, '[ \t\n]'), lambda x: length(x))) > size then 'run' else 'plain' end as kind
from one where length(t) > size
"""

P2_FOUND = """
with v as (select id, any_value(embedding) as e from chunks where len(embedding) = 64 and list_max(list_transform(embedding, lambda x: abs(x))) > 0 group by id),
s as (select a.id as a, b.id as b, list_cosine_similarity(a.e::double[], b.e::double[]) as s from v a join v b on a.id <> b.id),
n as (select a, b from (select *, row_number() over (partition by a order by s desc, b) as r from s) where r <= 5 and s >= 0.88)
select distinct least(a, b) as id_a, greatest(a, b) as id_b from n
"""

P5_FOUND = rf"""
with w as (select id, regexp_extract_all(lower(coalesce(title, '') || chr(10) || coalesce(content, '')), '[\p{{L}}\p{{N}}]+') as w from {_ONE}),
t as (select distinct id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as t from w where len(w) >= 3),
n as (select id, count(*) as n from t group by id),
p as (select a.id as id_a, b.id as id_b, count(*) as c from t a join t b on a.t = b.t and a.id < b.id group by 1, 2)
select id_a, id_b from p join n x on x.id = id_a join n y on y.id = id_b where 10 * c >= 6 * (x.n + y.n - c)
"""

P7_FOUND = r"""
with raw as (select thread_id, message, created_at, min(id) as id from messages where thread_id is not null group by all),
j as (select *, case when json_valid(message) and json_type(message) = 'OBJECT' then message::json end as m from raw),
f as (select thread_id, created_at, id, m, case when json_type(m, '$.role') = 'VARCHAR' and lower(trim(m->>'$.role')) in ('user', 'assistant', 'tool') then lower(trim(m->>'$.role')) end as role,
    coalesce(json_type(m, '$.content') = 'VARCHAR' and regexp_matches(m->>'$.content', '\S'), false) as content from j),
g as (select * from f where not (coalesce(role, '') = 'user' and coalesce(m->>'$.synthetic', '') = 'true')),
issued as (select thread_id, call, min((created_at, id)) as at from (select thread_id, created_at, id, unnest(json_extract_string(m, '$.toolCalls[*].id')) as call from g where role = 'assistant') group by all),
orphan as (select distinct g.thread_id from g left join issued i on g.thread_id = i.thread_id and i.call = g.m->>'$.toolCallId' where g.role = 'tool' and (i.at is null or i.at >= (g.created_at, g.id))),
e as (select thread_id, role, row_number() over w as n, lead(role) over w as next from g where role <> 'tool' and content window w as (partition by thread_id order by created_at, id)),
flow as (select thread_id, bool_or(n = 1 and role = 'assistant') as wrong, bool_or(role = 'user' and coalesce(next, 'user') = 'user') as open from e group by 1),
all_threads as (select id as thread_id from threads union select thread_id from g union select thread_id from raw),
v as (select a.thread_id, case
    when not exists (select 1 from threads t where t.id = a.thread_id) or a.thread_id in (select thread_id from g where role is null) or a.thread_id in (select thread_id from orphan) or coalesce(flow.wrong, false) then 'broken'
    when flow.thread_id is null then 'empty' when flow.open then 'no_reply' end as reason
  from all_threads a left join flow on a.thread_id = flow.thread_id where a.thread_id is not null)
select thread_id, reason from v where reason is not null
"""

# classes of more than 1,000 copies are told by their first member; there is none of that size in the test tables
P10_FOUND = """
with d as (select distinct doc_id, text from documents where length(text) >= 200),
w as (select distinct doc_id, h from (select doc_id, unnest(list_transform(range(1, length(text) - 198), lambda i: hash(text[i:i + 199]))) as h from d)),
m as (select h from w group by h having count(*) > 1),
s as (select w.* from w join m using (h))
select distinct a.doc_id as doc_a, b.doc_id as doc_b from s a join s b on a.h = b.h and a.doc_id < b.doc_id
"""

#: start: where a run of 200 characters begins that stands in another document, too
_SHARED = """
with d as (select distinct doc_id, text from documents where length(text) >= 200 and doc_id is not null),
w as (select doc_id, i - 1 as start, hash(text[i:i + 199]) as h from (select doc_id, text, unnest(range(1, length(text) - 198)) as i from d)),
m as (select h from w group by h having count(distinct doc_id) > 1),
s as (select doc_id, start, lag(start) over (partition by doc_id order by start) as before from w join m using (h))
"""

P10_SPANS = _SHARED + """, r as (select doc_id, start, sum((before is null or start > before + 200)::int) over (partition by doc_id order by start) as run from s)
select doc_id, min(start) as start, max(start) + 200 - min(start) as length from r group by doc_id, run
"""

P10_SHARES = _SHARED + """, c as (select doc_id, sum(case when before is null then 200 else least(200, start - before) end)::bigint as shared from s group by 1),
o as (select doc_id, any_value(coalesce(length(text), 0)) as n from documents where doc_id is not null group by 1)
select doc_id, n::bigint as n_chars, coalesce(shared, 0) as shared_chars, case when n > 0 then coalesce(shared, 0) / n else 0.0 end as share from o left join c using (doc_id)
"""

P5_GROUPS = rf"""
with recursive w as (select id, regexp_extract_all(lower(coalesce(title, '') || chr(10) || coalesce(content, '')), '[\p{{L}}\p{{N}}]+') as w from {_ONE}),
t as (select distinct id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as t from w where len(w) >= 3),
k as (select id, md5(string_agg(t, '|' order by t)) as key, count(*) as n from t group by id),
c as (select key, min(id) as first, count(*) as copies, any_value(n) as n from k group by key),
u as (select c.key, t.t from c join t on t.id = c.first),
p as (select a.key as a, b.key as b, count(*) as c from u a join u b on a.t = b.t and a.key <> b.key group by 1, 2),
l as (select a, b from p join c x on x.key = a join c y on y.key = b where 10 * p.c >= 6 * (x.n + y.n - p.c)),
r(a, b) as (select key, key from c union select r.a, l.b from r join l on l.a = r.b),
g as (select r.a as key, min(c.first) as "group" from r join c on c.key = r.b group by 1),
n as (select a as key, count(*) as links from l group by 1)
select w.id, coalesce(g."group", w.id) as "group", coalesce(c.copies, 1) as copies, coalesce(n.links, 0) as links from w left join k using (id) left join c using (key) left join g using (key) left join n using (key)
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p5_found": P5_FOUND, "p5_groups": P5_GROUPS, "p7_found": P7_FOUND, "p10_found": P10_FOUND, "p10_spans": P10_SPANS, "p10_shares": P10_SHARES}
