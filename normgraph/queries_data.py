"""Queries of the data operators and their SQL."""

from normgraph.operators.eav import p3_found, p3_wide
from normgraph.operators.hierarchy import p6_descendants, p6_found, p6_paths
from normgraph.operators.intervals import p5_found
from normgraph.operators.orphans import p2_found, p2_report

QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p3_wide": p3_wide, "p5_found": p5_found, "p6_found": p6_found, "p6_paths": p6_paths, "p6_descendants": p6_descendants}

_CITE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '^\s+|\s+$', '', 'g'), '^urn:external:', ''), '^directive:', ''), '^regulation:', ''), '\s+', ' ', 'g'))"

_P2 = f"""
with m as (select lower(trim(uri)) k, recorded_at t, coalesce(is_deleted, false) gone, [lower(trim(x.uri)) for x in agenda_items] items from meetings where uri is not null),
ml as (select k, min(t) first_at, max(row(t, gone, items)) last from m group by k),
mi as (select distinct unnest(items) k from (select arg_max(items, row(t, gone, items)) items, arg_max(gone, row(t, gone, items)) g from m group by k) where not g),
it as (select k, min(t) first_at from (select unnest(items) k, t from m) where k is not null group by k),
tg as (
  select 'meeting' ns, k, min(t) first_at, arg_max(gone, row(t, gone, items)) gone from m group by k
  union all select 'item', it.k, it.first_at, mi.k is null from it left join mi on it.k = mi.k
  union all select 'decision', lower(trim(uri)) k, min(recorded_at), arg_max(coalesce(is_deleted, false), row(recorded_at, coalesce(is_deleted, false))) from decisions where uri is not null group by 2
  union all select 'instrument', {_CITE.format(c="citation")} k, min(recorded_at), arg_max(coalesce(is_deleted, false), row(recorded_at, coalesce(is_deleted, false))) from instruments where citation is not null group by 2),
r as (
  select 'decisions' ref_table, f ref_field, row_id, ns, lower(trim(v)) k, recorded_at t from (
    select row_id, recorded_at, unnest([{{'f': 'meeting_uri', 'ns': 'meeting', 'v': meeting_uri}}, {{'f': 'agenda_item_uri', 'ns': 'item', 'v': agenda_item_uri}}, {{'f': 'supersedes_uri', 'ns': 'decision', 'v': supersedes_uri}}], recursive := true) from decisions)
  where starts_with(lower(trim(v)), 'urn:') or starts_with(lower(trim(v)), 'https:')
  union all select 'external_refs', 'ref_text', row_id, 'instrument', {_CITE.format(c="ref_text")}, recorded_at from external_refs where regexp_replace(ref_text, '\\s+', '', 'g') <> ''),
f as (select r.*, case when tg.k is null then 'missing' when tg.gone then 'deleted' else 'late' end reason from r left join tg on r.ns = tg.ns and r.k = tg.k where tg.k is null or tg.gone or tg.first_at > r.t)
"""

_CELLS = r"""
with a as (select predicate p, predicate n, value_type ty from attributes where cardinality = 'one' union select predicate, full_uri, value_type from attributes where cardinality = 'one'),
v as (select subject, a.p, a.ty, trim(object, e' \t') v from triples join a on triples.predicate = a.n where subject is not null and trim(object, e' \t') <> ''),
c as (select subject, p, v, case
  when ty = 'int' then case when regexp_full_match(v, '[+-]?[0-9]+') then cast(cast(v as hugeint) as varchar) end
  when ty = 'decimal' then case when regexp_full_match(v, '[+-]?[0-9]+(\.[0-9]+)?') then cast(cast(v as decimal(38,10)) as varchar) end
  when ty = 'date' then case when regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}(T[\s\S]*)?') then cast(try_cast(substr(v, 1, 10) as date) as varchar) end
  when ty = 'boolean' then case when lower(v) in ('true', 'yes', '1') then 'true' when lower(v) in ('false', 'no', '0') then 'false' end
  else v end x from v),
g as (select subject, p, count(*) - count(x) bad, count(distinct x) n, min(x) x from c group by 1, 2)
"""
_TYPES = {"rdf:type": "varchar", "reg:amendedCount": "bigint", "reg:confidence": "decimal(38,10)", "reg:effectiveDate": "date", "reg:feeAmount": "decimal(38,10)", "reg:inForce": "boolean", "reg:language": "varchar", "reg:number": "bigint", "reg:partOf": "varchar", "reg:repealedOn": "date", "reg:reviewDate": "date", "reg:title": "varchar", "reg:wordCount": "bigint"}
_COLUMNS = ", ".join(f"cast(max(case when p = '{p}' and bad = 0 and n = 1 then x end) as {ty}) {p.replace(':', '_').lower()}" for p, ty in _TYPES.items())

_TREE = """
with recursive l as (select upper(trim(id)) id, nullif(upper(trim(parent)), '') parent, row_number() over (partition by upper(trim(id)) order by recorded_at desc, parent desc nulls last) rn from institutions where trim(id) <> ''),
n as (select l.id, p.id parent from l left join (select distinct id from l) p on l.parent = p.id where rn = 1),
t as (select id, id root, 0 depth, id path from n where parent is null union all select n.id, t.root, t.depth + 1, t.path || '/' || n.id from n join t on n.parent = t.id),
u as (select id, parent anc from n where parent is not null and id in (select id from t) union all select u.id, n.parent from u join n on u.anc = n.id where n.parent is not null),
s as (select anc, count(*) c from u group by 1)
"""

SQL = {
    "p2_found": _P2 + "select ref_table, ref_field, row_id from f",
    "p2_report": _P2 + "select ref_table, ref_field, strftime(t, '%Y-%m') as month, reason, count(*) as n_failed from f group by 1, 2, 3, 4",
    "p3_found": _CELLS + "select subject, p as predicate from g where bad > 0 or n > 1",
    "p3_wide": _CELLS + f"select s.subject, {_COLUMNS} from (select distinct subject from triples where subject is not null and predicate is not null) s left join g on s.subject = g.subject group by s.subject",
    "p5_found": """
with r as (select speaker_uri, lower(trim(role)) as role, start_date s, coalesce(end_date, date '9999-12-31') e from role_assignments where start_date is not null and (end_date is null or end_date >= start_date)),
f as (select *, case when s <= max(e) over w + 1 then 0 else 1 end fresh from r window w as (partition by speaker_uri, role order by s, e rows between unbounded preceding and 1 preceding)),
g as (select *, sum(fresh) over (partition by speaker_uri, role order by s, e rows unbounded preceding) k from f),
p as (select speaker_uri, role, k, min(s) a, max(e) b from g group by 1, 2, 3),
n as (select *, lead(a) over (partition by speaker_uri, role order by k) nxt from p)
select speaker_uri, role, 'period' as kind, strftime(a, '%Y-%m-%d') as from_date, case when b = date '9999-12-31' then 'open' else strftime(b, '%Y-%m-%d') end as to_date from n
union all select speaker_uri, role, 'gap', strftime(b + 1, '%Y-%m-%d'), strftime(nxt - 1, '%Y-%m-%d') from n where nxt is not null""",
    "p6_found": _TREE + "select n.id as institution_id, coalesce(t.root, 'cycle') as root_id, cast(coalesce(t.depth, -1) as bigint) as depth, cast(case when t.id is null then -1 else coalesce(s.c, 0) end as bigint) as n_descendants from n left join t on n.id = t.id left join s on n.id = s.anc",
    "p6_descendants": _TREE + "select anc as institution_id, id as descendant_id from u",
    "p6_paths": _TREE + "select id as institution_id, path from t",
}
