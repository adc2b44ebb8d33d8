"""Queries of the training-data operators."""

from normgraph.llm.leakage import p8_extent, p8_found
from normgraph.llm.names import p1_entities, p1_found
from normgraph.llm.near_duplicates import p4_found, p4_groups
from normgraph.llm.sentences import p9_found
from normgraph.llm.tokens import p7_ids

QUERIES = {"p1_found": p1_found, "p1_entities": p1_entities, "p4_found": p4_found, "p4_groups": p4_groups, "p7_ids": p7_ids, "p8_found": p8_found, "p8_extent": p8_extent, "p9_found": p9_found}

_WORDS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{M}}\p{{N}}]+')"
_RUNS = "list_transform(range(1, len(w) - {last}), lambda i: array_to_string(w[i : i + {more}], ' '))"
_THREE, _TWELVE = _RUNS.format(last=1, more=2), _RUNS.format(last=10, more=11)

SQL = {
    "p4_found": f"""with t as (select change_id, unnest([base_text, target_text]) x from (select distinct change_id, base_text, target_text from clause_changes where change_id is not null)),
w as (select change_id, {_WORDS.format(c="x")} w from t where x is not null),
g as (select distinct change_id, unnest({_THREE}) g from w where len(w) >= 3),
n as (select change_id, count(*) n from g group by 1 having count(*) >= 15),
r as (select g.* from g semi join n using (change_id)),
j as (select a.change_id x, b.change_id y, count(*) k from r a join r b on a.g = b.g and a.change_id < b.change_id group by 1, 2)
select x as change_a, y as change_b from j join n a on x = a.change_id join n b on y = b.change_id where k / (a.n + b.n - k) >= 0.6""",
    "p8_found": f"""with d as (select doc_id, {_WORDS.format(c="text")} w from documents where text is not null), i as (select item_id, {_WORDS.format(c="text")} w from eval_items where text is not null),
x as (select distinct doc_id, unnest({_TWELVE}) g from d where len(w) >= 12), y as (select distinct item_id, unnest({_TWELVE}) g from i where len(w) >= 12)
select distinct doc_id, item_id from x join y using (g)""",
}
