"""The same results in SQL, for checking."""

from __future__ import annotations

from setweave.functions.text import sql_tokens

_RECORDS = f"""records as (select _id, text, title from corpus where _id is not null
  qualify row_number() over (partition by _id order by fetched_at desc) = 1),
 sets as (select 'corpus' as kind, _id as id, list_distinct({sql_tokens('text')}) as s from records),
 nodes as (select distinct u, v from edge_pairs where u is not null and v is not null and u <> v),
 elems as (select kind, id, unnest(s) as e, len(s) as n from sets where len(s) >= 8
  union all select 'node', u::varchar, v::varchar, count(*) over (partition by u) from nodes
   qualify count(*) over (partition by u) >= 5),
 shared as (select a.kind, a.id as id_a, b.id as id_b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as i
  from elems a join elems b on a.kind = b.kind and a.e = b.e and a.id < b.id group by 1, 2, 3),
 pairs as (select kind, id_a, id_b from shared where i / (na + nb - i) >= 0.6)"""
_SAME = """every as (select kind, id, list_sort(s) as k from sets where len(s) >= 8 union all select 'node', u::varchar, list_sort(list(v)) from nodes group by u having count(*) >= 5),
 named as (select kind, id, min(id) over (partition by kind, k) as class_id from every),
 met as (select kind, id_a as id from pairs union all select kind, id_b from pairs), counted as (select kind, id, count(*) as links from met group by 1, 2)"""
_GROUPS = f"""records as (select _id, text, title from corpus where _id is not null
  qualify row_number() over (partition by _id order by fetched_at desc) = 1),
 t as (select _id, {sql_tokens("coalesce(title, '') || ' ' || coalesce(text, '')")} as t from records),
 s as (select _id, unnest(list_distinct([t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] for i in range(1, len(t) - 1)])) as e from t where len(t) >= 8),
 n as (select _id, count(*) as n from s group by 1),
 p as (select a._id as x, b._id as y, count(*) as i from s a join s b on a.e = b.e and a._id <> b._id group by 1, 2),
 l as (select x, y from p join n nx on nx._id = x join n ny on ny._id = y where i / (nx.n + ny.n - i) >= 0.5),
 r as (select distinct x as node, x as other from l union select r.node, l.y from r join l on r.other = l.x),
 g as (select min(other) as group_id, node as member_id from r group by node)"""
_TERMS = f"""records as (select _id, text from corpus where _id is not null
  qualify row_number() over (partition by _id order by fetched_at desc, text desc nulls last) = 1),
 w as (select _id, unnest({sql_tokens('text')}) as term from records),
 terms as (select term, count(*)::bigint as occurrences, count(distinct _id)::bigint as df from w group by 1)"""
_SCORED = f"""with {_TERMS}, coll as (select term, df, occurrences as cf, (select count(*) from records) as n from terms),
 q as (select distinct _id, text from queries where _id is not null qualify row_number() over (partition by _id order by text desc nulls last) = 1),
 every as (select 'corpus' as origin, _id as record_id, {sql_tokens('text')} as t from records union all select 'queries', _id, {sql_tokens('text')} from q),
 tf as (select origin, record_id, term, count(*)::bigint as tf, any_value(n)::bigint as length from (select origin, record_id, unnest(t) as term, len(t) as n from every) group by 1, 2, 3),
 scored as (select origin, record_id, term, tf, length, df, cf, n from tf join coll using (term))"""

_LEAKS = f"""with dt as (select doc_id, {sql_tokens('text')} as t from documents), it as (select item_id, {sql_tokens('text')} as t from eval_items),
 dw as (select distinct doc_id, unnest([array_to_string(t[i:i + 9], ' ') for i in range(1, len(t) - 8)]) as w from dt where len(t) >= 10),
 iw as (select distinct item_id, unnest([array_to_string(t[i:i + 9], ' ') for i in range(1, len(t) - 8)]) as w from it where len(t) >= 10)"""

SQL: dict[str, str] = {
    "p1_found": f"with {_RECORDS} select kind, id_a, id_b from pairs",
    "p1_links": f"with {_RECORDS}, {_SAME} select kind, id, class_id, coalesce(links, 0)::bigint as links from named left join counted using (kind, id)",
    "p2_found": f"""with {_TERMS} select term, case when df < 3 then 'rare' else 'common' end as mark from terms where df < 3 or df > 0.4 * (select count(*) from records)""",
    "p2_counts": f"""with {_TERMS} select term, occurrences, df as records,
  case when df < 3 then 'rare' when df > 0.4 * (select count(*) from records) then 'common' end as mark from terms""",
    "p4_found": f"""{_SCORED}, best as (select *, round(tf * ln((n + 1) / (1 + df)), 9) as score from scored)
 select origin, record_id, term from best qualify score = max(score) over (partition by origin, record_id)""",
    "p4_weights": f"""{_SCORED}, f as (select *, tf * log2(1 + (select sum(cf) / any_value(n) from coll) / length) as tfn, cf / n as l from scored)
 select origin, record_id, term, tf, df, round((log2(1 + l) + tfn * log2((1 + l) / l)) / (tfn + 1), 6) as weight from f""",
    "p5_found": f"with recursive {_GROUPS} select group_id, member_id from g",
    "p5_groups": f"""with recursive {_GROUPS}, every as (select coalesce(group_id, _id) as group_id, _id as member_id from n left join g on member_id = _id)
 select group_id, member_id, count(*) over (partition by group_id)::bigint as n_members from every""",
    "p7_passages": f"{_LEAKS} select doc_id, item_id, count(distinct w)::bigint as windows from dw join iw using (w) group by 1, 2",
    "p7_found": f"{_LEAKS} select distinct doc_id, item_id from dw join iw using (w)",
    "p8_found": f"""with t as (select source, len({sql_tokens('text')}) as n from documents), s as (select source, sum(n) as size from t group by 1)
 select g.source from source_targets g left join s using (source) where g.target_share * (select sum(n) from t) > g.max_repeats * coalesce(s.size, 0)""",
    "p6_found": """with nodes as (select distinct u, v from edge_pairs where u is not null and v is not null and u <> v),
 big as (select u, v, count(*) over (partition by u) as n from nodes qualify count(*) over (partition by u) >= 100)
 select a.u as u_a, b.u as u_b from big a join big b on a.v = b.v and a.u < b.u
 group by 1, 2 having count(*) / least(any_value(a.n), any_value(b.n)) >= 0.2""",
}
