"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

OP1 = """
with lines as (
  select doc_id, source, text, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as line
  from documents
), solid as (select * from lines where trim(line, ' ') <> ''),
boiler as (select line from solid group by line having count(distinct coalesce('s' || source, '')) >= 10),
firsts as (select line, min(struct_pack(doc_id := doc_id, pos := pos)) as f from solid semi join boiler using (line) group by line),
marked as (
  select l.doc_id, l.pos, l.line, trim(l.line, ' ') <> '' as solid,
    coalesce(f.f is not null and (l.doc_id, l.pos) <> (f.f.doc_id, f.f.pos), false) and trim(l.line, ' ') <> '' as gone
  from lines l left join firsts f using (line)
), per as (
  select doc_id, count(*) filter (solid) as n_lines, count(*) filter (gone) as n_removed,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
  from marked group by doc_id
)
select d.doc_id, coalesce(p.n_lines, 0) as n_lines, coalesce(p.n_removed, 0) as n_removed, coalesce(p.kept_sha256, sha256('')) as kept_sha256
from documents d left join per p using (doc_id)
"""

_ESC = "replace(replace(replace({0}, '\\', '\\e'), '<', '\\l'), '#', '\\h')"
OP7 = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(4 + length(replace({_ESC.format("role")}, ':', '\\c')) + 2 + length({_ESC.format("text")}) + 8)::bigint as formatted_chars
from turns group by conv_id
"""

OP9 = """
with sized as (
  select doc_id, coalesce(doc_id::varchar, 'null ' || coalesce(md5(text), '')) as key, source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents
), per as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select source, source_size, source_size * 3 as cap, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as weight from per
), ordered as (
  select *, sum(source_size) over () as words, sum(weight) over () as weights,
    coalesce(sum(cap) over w, 0) as cap_before, coalesce(sum(weight) over w, 0) as weight_before
  from weighed window w as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)
), flagged as (select *, cap * (weights - weight_before) < weight * (words - cap_before) as capped from ordered),
leveled as (
  select *, (words - sum(case when capped then cap else 0 end) over ())::double / nullif(sum(case when capped then 0 else weight end) over (), 0)::double as level from flagged
), targets as (select source, source_size, case when capped then cap::double else coalesce(level * weight, cap::double) end as target from leveled),
expected as (
  select s.doc_id, s.key, s.source, s.size, t.source_size, t.target,
    case when s.size > 0 and t.source_size > 0 then least(3.0::double, t.target / t.source_size::double) else 0.0::double end as e,
    (('0x' || substr(md5(s.key), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double as u
  from sized s join targets t on s.source is not distinct from t.source
), keyed as (
  select *, floor(e)::bigint as whole, e - floor(e) as p from expected
), ranked as (
  select *, case when p > 0 then (u / (1 - u)) * ((1 - p) / p) end as q, target - sum(whole * size) over (partition by source) as rest from keyed
), placed as (
  select *, sum(case when q is null then 0 else size end) over (partition by source order by case when q is null then 0 else 1 end, q / (1 + q), doc_id, size, key rows unbounded preceding) as upto from ranked
)
select doc_id, size, source_size, target, ((whole + case when q is not null and 2 * upto - size <= 2 * rest then 1 else 0 end) * size)::bigint as taken from placed
"""

_COMPONENTS = """
reach as (
  select id, id as dest from nodes
  union
  select r.id, l.b as to from reach r join both_ways l on r.dest = l.a
), comp as (select id, min(dest) as component_id from reach group by id)
"""

OP4 = f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents
), sets as (
  select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) end) as s from w
), items as (select doc_id, len(s) as n, unnest(s) as x from sets), shared as (
  select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as hits from items a join items b on a.x = b.x and a.doc_id < b.doc_id
  where 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by all
), links as (select a, b from shared where 100 * hits >= 85 * (na + nb - hits)),
both_ways as (select a, b from links union select b, a from links), nodes as (select doc_id as id from documents), {_COMPONENTS}
select doc_id, len(s) as n_shingles, component_id, doc_id = component_id as kept from sets join comp on id = doc_id
"""

OP8 = f"""
with recursive e as (
  select vec_id as id, label, embedding::double[] as v, embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0 and label is not null as fine from embeddings
), n as (select id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from e where fine),
links as (
  select a.id as a, b.id as b from n a join n b on a.label = b.label and a.id < b.id and len(a.v) = len(b.v)
  where list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / (a.norm * b.norm) >= 0.93
), both_ways as (select a, b from links union select b, a from links), nodes as (select id from e), {_COMPONENTS}
select e.id as vec_id, coalesce(k.n, 0) as n_links, component_id, e.id = component_id as kept
from e join comp using (id) left join (select a, count(*) as n from both_ways group by a) k on k.a = e.id
"""

OP10 = """
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents
), windows as (
  select doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w)
), firsts as (select h, min(doc_id) as first from windows group by h having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as pos from windows join firsts using (h) where doc_id > first),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from w),
kept as (
  select k.doc_id, count(g.pos) as n_removed, string_agg(word, ' ' order by k.pos) filter (g.pos is null) as text
  from words k left join gone g on g.doc_id = k.doc_id and g.pos = k.pos group by k.doc_id
)
select w.doc_id, len(ws) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256 from w left join kept using (doc_id)
"""

ORACLES = {"op1_line_dedup": OP1, "op4_minhash_dedup": OP4, "op7_chat_formatting": OP7, "op8_metric_join": OP8, "op9_mixing": OP9, "op10_substring_dedup": OP10}
