"""Queries of the graph engine over the relational tables, the library's triples and the events, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.operators import documents as docs
from normgraph.operators import traversal as walk
from normgraph.operators import versions as ver
from normgraph.operators import voting
from normgraph.operators.graph import TripleGraph, relationship_summary
from normgraph.sources.tables import provision_graph, relational_graph


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sparql(text: str, tables: tuple[str, ...]):
    return lambda spark, d: relational_graph(spark, d, tables).query(text)


def _library(text: str, **more):
    return lambda spark, d: provision_graph(spark, d).query(text, **more)


_STAR = ("region", "nation", "customer", "supplier", "orders")
SPARQL = {
    "s1_pattern": _sparql("SELECT ?nation ?name WHERE { ?nation a t:Nation ; t:name ?name }", ("region", "nation")),
    "s2_join": _sparql('SELECT ?c ?name WHERE { ?c a t:Customer ; t:name ?name . ?c t:segment "BUILDING" }', ("customer",)),
    "s3_join": _sparql("SELECT ?o ?c ?n WHERE { ?o t:customer ?c . ?c t:nation ?n . ?n t:region region:2 }", _STAR),
    "s4_join": _sparql('SELECT ?o ?total WHERE { ?o t:customer ?c ; t:total ?total ; t:status "F" . ?c t:nation nation:7 }', _STAR),
    "s5_join": _sparql("SELECT ?l ?c WHERE { ?l t:order ?o ; t:flag \"R\" . ?o t:customer ?c . ?c t:nation ?n . ?n t:region region:1 . FILTER(STRENDS(?l, \":1\")) }", (*_STAR, "lineitem")),
    "s_optional": _sparql("SELECT ?s ?b ?g WHERE { ?s t:nation nation:3 ; t:balance ?b . OPTIONAL { ?s t:segment ?g } }", ("customer", "supplier")),
    "s_not_bound": _sparql("SELECT ?s WHERE { ?s t:nation ?n . OPTIONAL { ?s t:segment ?g } FILTER(!BOUND(?g)) }", ("customer", "supplier")),
    "s_filter_number": _sparql("SELECT ?c ?b WHERE { ?c t:segment ?g ; t:balance ?b . FILTER(?b > 5000 && ?b <= 7500.5) }", ("customer",)),
    "s_filter_text": _sparql('SELECT ?p ?n WHERE { ?p t:name ?n ; t:brand ?b . FILTER(REGEX(?n, "[13579]$") || CONTAINS(?b, "5")) FILTER(?b != "Brand#1") }', ("part",)),
    "s_group": _sparql("SELECT ?nation ?name (COUNT(?cust) AS ?n) WHERE { ?nation a t:Nation . ?nation t:name ?name . ?cust t:nation ?nation . ?cust a t:Customer } GROUP BY ?nation ?name ORDER BY DESC(?n) ?name LIMIT 20", ("nation", "customer")),
    "s_aggregates": _sparql("SELECT ?seg (COUNT(DISTINCT ?n) AS ?nations) (MIN(?b) AS ?low) (MAX(?b) AS ?high) (COUNT(?c) AS ?n_customers) WHERE { ?c t:segment ?seg ; t:balance ?b ; t:nation ?n } GROUP BY ?seg", ("customer",)),
    "s_having": _sparql("SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o t:customer ?c } GROUP BY ?c HAVING(COUNT(?o) > 15)", ("orders",)),
    "s_distinct": _sparql("SELECT DISTINCT ?priority ?status WHERE { ?o t:priority ?priority ; t:status ?status }", ("orders",)),
    "s_slice": _sparql("SELECT ?c ?name WHERE { ?c t:name ?name ; a t:Customer } ORDER BY DESC(?name) LIMIT 25 OFFSET 10", ("customer",)),
    "s_construct": _sparql("CONSTRUCT { ?o t:placedFrom ?n . ?n t:places ?o } WHERE { ?o t:customer ?c . ?c t:nation ?n }", ("customer", "orders")),
    "s_describe": _sparql("DESCRIBE nation:3 region:1", _STAR[:4]),
    "s_describe_variable": _sparql('DESCRIBE ?n WHERE { ?n t:region ?r . ?r t:name ?name . FILTER(?name = "ASIA") }', ("region", "nation", "supplier")),
    "s_library_join": _library('SELECT ?x ?title ?n WHERE { ?x a reg:Article ; reg:title ?title ; reg:number ?n . FILTER(?n > 700) }'),
    "s_library_optional": _library('SELECT ?x ?l ?d WHERE { ?x reg:language ?l . OPTIONAL { ?x reg:repealedOn ?d } FILTER(?l = "de") }'),
    "s_library_group": _library("SELECT ?number (COUNT(DISTINCT ?x) AS ?n) WHERE { ?x reg:number ?number } GROUP BY ?number HAVING(COUNT(DISTINCT ?x) >= 3) ORDER BY DESC(?n)"),
}


def g_find(spark, d):
    return relational_graph(spark, d, ("nation", "customer", "supplier")).find(p="t:nation", o="nation:3")


def g_stats(spark, d):
    return relational_graph(spark, d).stats()


def g_predicate_counts(spark, d):
    return provision_graph(spark, d).counts("p")


def g_merge_delete(spark, d):
    a, b = relational_graph(spark, d, ("nation", "region")), relational_graph(spark, d, ("region", "supplier"))
    return TripleGraph(a.df).add(b.df).delete(p="rdf:type").delete_all(b.find(p="t:balance")).triples


def g_added(spark, d):
    return relational_graph(spark, d, ("region", "nation")).added_by(relational_graph(spark, d, ("nation", "supplier")).df)


def g_degrees(spark, d):
    return relationship_summary(relational_graph(spark, d, ("nation", "customer", "supplier", "orders")), ("t:nation", "t:region", "t:customer"))


def g_export(spark, d):
    _, edges = relational_graph(spark, d, ("nation", "customer", "orders")).nodes_and_edges(("t:nation", "t:customer", "t:region"))
    return edges


def g_impact(spark, d):
    g = relational_graph(spark, d, ("region", "nation", "customer", "orders"))
    links = ("t:region", "t:nation", "t:customer")
    return walk.impact(g, "nation:3", 2, "both", links, (), links, links).select("node", "depth", "direction")


def g_subgraph(spark, d):
    return walk.subgraph(relational_graph(spark, d, ("region", "nation", "supplier")), "region:1", 2)[0]


def g_path(spark, d):
    return walk.shortest_path(relational_graph(spark, d, ("nation", "customer")), "customer:1", "customer:2", 4)


def g_components(spark, d):
    refs = _t(spark, d, "external_refs").filter("ref_text is not null").select(F.concat_ws("#", "document", "provision").alias("x"), F.concat(F.lit("ref:"), F.lower("ref_text")).alias("y"))
    return walk.components(refs).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def g_loops(spark, d):
    i = _t(spark, d, "institutions").select(F.upper(F.trim("id")).alias("x"), F.upper(F.trim("parent")).alias("y"))
    return walk.on_loops(i.filter("y <> ''"))


def g_contained(spark, d):
    g = relational_graph(spark, d, ("region", "nation", "customer"))
    return walk.contained(g, "region:2", (), ("t:region", "t:nation"))


def d_overlaps(spark, d):
    t = _t(spark, d, "triples").filter("predicate in ('reg:number', 'https://norms.example/ontology#number') and trim(object) <> ''")
    return docs.overlaps(t.select(F.trim("object").alias("concept"), F.col("document").alias("doc"), F.col("subject").alias("provision"))).select("concept", "n_docs", "n_provisions")


def d_compare(spark, d):
    t = _t(spark, d, "triples").filter("predicate = 'reg:term' and trim(object) <> ''")
    return docs.compare_documents(t.select(F.trim("object").alias("concept"), F.col("document").alias("doc")), "zz-lib-00000", "zz-lib-00001")


def d_reference_clusters(spark, d):
    return docs.reference_clusters(_t(spark, d, "external_refs"), F.trim(F.regexp_replace(F.lower("ref_text"), r"\s+", " ")))


def d_matrix(spark, d):
    l, o, c, s = (_t(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    pairs = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, l["l_suppkey"] == s["s_suppkey"]).select(F.col("c_nationkey").cast("string").alias("source"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("t"), "s_nationkey", "c_nationkey").filter("s_nationkey <> c_nationkey")
    return docs.reference_matrix(pairs, "source", "t", [f"n{k}" for k in range(25)])


def d_margins(spark, d):
    c = _t(spark, d, "clause_changes").filter("base_version is not null and target_version is not null")
    return docs.matrix_margins(c, "base_version", "target_version")


def d_summary(spark, d):
    return docs.document_summary(_t(spark, d, "triples").select("document", F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o")))


def d_version_diff(spark, d):
    c = _t(spark, d, "clause_changes").filter("rule_no is not null and clause is not null")
    side = lambda v: c.filter(F.col("base_version") == v).groupBy("rule_no", "clause").agg(F.max("clause_title").alias("title"))
    return docs.keyed_diff(side("114th"), side("115th"), ["rule_no", "clause"], "title")


def _votes(spark, d):
    """Events as votes: the hour is the vote, its number in the day the topic, the user the voter."""
    e = _t(spark, d, "events")
    position = F.element_at(F.array(*map(F.lit, ("for", "for", "against", "abstain", "absent"))), (F.pmod(F.col("event_id") + F.col("user_id"), F.lit(5)) + 1).cast("int"))
    return e.select(F.date_format("ts", "yyyy-MM-dd HH").alias("vote"), F.hour("ts").cast("bigint").alias("topic"), F.col("user_id").alias("voter"), position.alias("position"))


def _history(spark, d):
    return ver.version_history(_t(spark, d, "events"), "user_id", "ts", "event_id")


def _day(n):
    return F.lit(f"2024-01-{n} 00:00:00").cast("timestamp_ntz")


def v_changes(spark, d):
    return ver.changes_between(_history(spark, d), _day(10), _day(20))


def v_as_of_join(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.expr("make_interval(0, 0, 0, cast(o_orderkey % 30 as int))")).alias("at"))
    return ver.as_of_join(o, _history(spark, d), "user_id", "at").select("user_id", "o_orderkey", F.col("version").cast("bigint").alias("version"))


def v_timeline(spark, d):
    m, dec = _t(spark, d, "meetings"), _t(spark, d, "decisions")
    return ver.timeline_span(ver.timeline([(m, "process_uri", "meeting_date", "meeting"), (dec.join(m.select("uri", "process_uri").distinct(), dec["meeting_uri"] == m["uri"]).select("process_uri", "decided_at"), "process_uri", "decided_at", "decision")]))


def v_overlapping(spark, d):
    r = _t(spark, d, "role_assignments").filter("start_date is not null and (end_date is null or end_date >= start_date)").select("speaker_uri", "assignment_id", "start_date", "end_date").distinct()
    return ver.overlapping(r, r, ["speaker_uri"]).filter("assignment_id < b_assignment_id").select("speaker_uri", "assignment_id", "b_assignment_id")


QUERIES = SPARQL | {f.__name__: f for f in (g_find, g_stats, g_predicate_counts, g_merge_delete, g_added, g_degrees, g_export, g_impact, g_subgraph, g_path, g_components, g_loops, g_contained, d_overlaps, d_compare, d_reference_clusters, d_matrix, d_margins, d_summary, d_version_diff, v_changes, v_as_of_join, v_timeline, v_overlapping)} | {
    "b_profiles": lambda s, d: voting.voter_profiles(_votes(s, d)),
    "b_coalitions": lambda s, d: voting.coalitions(_votes(s, d), 0.05),
    "b_swing_voters": lambda s, d: voting.swing_voters(_votes(s, d)),
    "b_opponents": lambda s, d: voting.consistent_opponents(_votes(s, d)),
    "b_topics": lambda s, d: voting.topic_clusters(_votes(s, d)),
    "v_versions": _history,
    "v_at": lambda s, d: ver.versions_at(_history(s, d), _day(20)),
    "v_summary": lambda s, d: ver.change_summary(ver.changes_between(_history(s, d), _day(10), _day(20))),
    "v_durations": lambda s, d: ver.durations(_history(s, d)),
}

_LIB = "with n as (select distinct subject s, coalesce(a.predicate, t.predicate) p, object o, document doc from triples t left join attributes a on t.predicate = a.full_uri where subject <> '' and t.predicate <> '' and object <> ''), t as (select distinct s, p, o from n) "
_NUM = r"case when regexp_full_match({c}, '[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?') then cast({c} as double) end"
_EV = "with v as (select user_id subject, row_number() over w as version, ts valid_from, lead(ts) over w valid_until from events window w as (partition by user_id order by ts, event_id)) "
_VOTES = "with v as (select strftime(ts, '%Y-%m-%d %H') vote, hour(ts) topic, user_id voter, ['for', 'for', 'against', 'abstain', 'absent'][((event_id + user_id) % 5) + 1] as position from events) "
_TOPIC = "b as (select voter, topic, count(*) n, count(distinct position) positions, count(*) filter (where position = 'against') against from v group by 1, 2) "


def _unpivot(table: str) -> str:
    from normgraph.sources.tables import RELATIONAL

    keys, columns = RELATIONAL[table]
    s = f"'{table}:' || " + " || ':' || ".join(keys)
    out = [f"select {s} as s, 'rdf:type' as p, 't:{table.capitalize()}' as o from {table}"]
    for p, (c, target) in columns.items():
        o = f"'{target}:' || {c}" if target else f"cast({c} as varchar)"
        out.append(f"select {s}, '{p}', {o} from {table} where {c} is not null")
    return " union all ".join(out)


def _graph(*tables: str) -> str:
    return "with t as (" + " union all ".join(map(_unpivot, tables)) + ") "


SQL = {
    "s1_pattern": "select 'nation:' || n_nationkey as nation, n_name as name from nation",
    "s2_join": "select 'customer:' || c_custkey as c, c_name as name from customer where c_mktsegment = 'BUILDING'",
    "s3_join": "select 'orders:' || o_orderkey as o, 'customer:' || c_custkey as c, 'nation:' || n_nationkey as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_regionkey = 2",
    "s4_join": "select 'orders:' || o_orderkey as o, cast(o_totalprice as varchar) as total from orders join customer on o_custkey = c_custkey where c_nationkey = 7 and o_orderstatus = 'F'",
    "s5_join": "select distinct 'lineitem:' || l_orderkey || ':' || l_linenumber as l, 'customer:' || c_custkey as c from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_regionkey = 1 and l_returnflag = 'R' and l_linenumber = 1",
    "s_optional": "select 'customer:' || c_custkey as s, cast(c_acctbal as varchar) as b, c_mktsegment as g from customer where c_nationkey = 3 union all select 'supplier:' || s_suppkey, cast(s_acctbal as varchar), null from supplier where s_nationkey = 3",
    "s_not_bound": "select 'supplier:' || s_suppkey as s from supplier where s_nationkey is not null",
    "s_filter_number": "select 'customer:' || c_custkey as c, cast(c_acctbal as varchar) as b from customer where c_acctbal > 5000 and c_acctbal <= 7500.5",
    "s_filter_text": "select 'part:' || p_partkey as p, p_name as n from part where (regexp_matches(p_name, '[13579]$') or contains(p_brand, '5')) and p_brand <> 'Brand#1'",
    "s_group": "select 'nation:' || n_nationkey as nation, n_name as name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1, 2 order by 3 desc, 2 limit 20",
    "s_aggregates": "select c_mktsegment as seg, count(distinct c_nationkey) as nations, cast(min(c_acctbal) as varchar) as low, cast(max(c_acctbal) as varchar) as high, count(*) as n_customers from customer group by 1",
    "s_having": "select 'customer:' || o_custkey as c, count(*) as n from orders group by 1 having count(*) > 15",
    "s_distinct": "select distinct o_orderpriority as priority, o_orderstatus as status from orders",
    "s_slice": "select 'customer:' || c_custkey as c, c_name as name from customer order by c_name desc limit 25 offset 10",
    "s_construct": "select distinct unnest(['orders:' || o_orderkey, 'nation:' || c_nationkey]) as s, unnest(['t:placedFrom', 't:places']) as p, unnest(['nation:' || c_nationkey, 'orders:' || o_orderkey]) as o from orders join customer on o_custkey = c_custkey",
    "s_describe": _graph("region", "nation", "customer", "supplier") + "select distinct s, p, o from t where s in ('nation:3', 'region:1') or o in ('nation:3', 'region:1')",
    "s_describe_variable": _graph("region", "nation", "supplier") + ", x as (select a.s n from t a join t b on a.o = b.s and b.p = 't:name' and b.o = 'ASIA' where a.p = 't:region') select distinct s, p, o from t where s in (select n from x) or o in (select n from x)",
    "s_library_join": _LIB + f"select a.s as x, b.o as title, c.o as n from t a join t b on a.s = b.s join t c on a.s = c.s where a.p = 'rdf:type' and a.o = 'reg:Article' and b.p = 'reg:title' and c.p = 'reg:number' and {_NUM.format(c='c.o')} > 700",
    "s_library_optional": _LIB + "select a.s as x, a.o as l, b.o as d from t a left join t b on a.s = b.s and b.p = 'reg:repealedOn' where a.p = 'reg:language' and a.o = 'de'",
    "s_library_group": _LIB + "select o as number, count(distinct s) as n from t where p = 'reg:number' group by 1 having count(distinct s) >= 3",
    "g_find": _graph("nation", "customer", "supplier") + "select s, p, o from t where p = 't:nation' and o = 'nation:3'",
    "g_stats": _graph("region", "nation", "customer", "supplier", "part", "orders", "lineitem") + "select count(distinct (s, p, o)) as triples, count(distinct s) as subjects, count(distinct p) as predicates, count(distinct o) as objects from t where o <> ''",
    "g_predicate_counts": _LIB + "select p, count(*) as n from t group by 1",
    "g_merge_delete": _graph("nation", "region", "supplier") + "select distinct s, p, o from t where p <> 'rdf:type' and p <> 't:balance'",
    "g_added": _graph("supplier") + "select s, p, o from t",
    "g_degrees": _graph("nation", "customer", "supplier", "orders") + ", e as (select s, o from t where p in ('t:nation', 't:region', 't:customer')) select node, cast(sum(a) as bigint) as out_degree, cast(sum(b) as bigint) as in_degree from (select s node, 1 a, 0 b from e union all select o, 0, 1 from e) group by 1",
    "g_export": _graph("nation", "customer", "orders") + "select s as source, p as predicate, o as target from t where p in ('t:nation', 't:customer', 't:region')",
    "g_impact": "select 'region:' || n_regionkey as node, 1 as depth, 'outgoing' as direction from nation where n_nationkey = 3 union all select 'customer:' || c_custkey, 1, 'incoming' from customer where c_nationkey = 3 union all select 'orders:' || o_orderkey, 2, 'incoming' from orders join customer on o_custkey = c_custkey where c_nationkey = 3 union all select 'nation:' || b.n_nationkey, 2, 'incoming' from nation a join nation b on a.n_regionkey = b.n_regionkey where a.n_nationkey = 3 and b.n_nationkey <> 3",
    "g_subgraph": _graph("region", "nation", "supplier") + ", e as (select s x, o y from t union select o, s from t), a as (select distinct y from e where x = 'region:1'), b as (select distinct e.y from e join a on e.x = a.y where e.y <> 'region:1' and e.y not in (select y from a)) select 'region:1' as node, 0 as depth union all select y, 1 from a union all select y, 2 from b",
    "g_components": "with recursive e as (select distinct concat_ws('#', document, provision) x, 'ref:' || lower(ref_text) y from external_refs where ref_text is not null), b as (select x, y from e union select y, x from e), r(n, c) using key (n) as (select x, least(x, min(y)) from b group by x union select b.x, min(r.c) from b join r on b.y = r.n join recurring.r q on q.n = b.x group by b.x, q.c having min(r.c) < q.c) select c as component, count(*) as n from r group by 1",
    "g_path": _graph("nation", "customer") + ", e as (select s x, o y from t union select o, s from t), m as (select min(a.y) y from e a join e b on a.y = b.x where a.x = 'customer:1' and b.y = 'customer:2') select unnest([0, 1, 2]) as position, unnest(['customer:1', y, 'customer:2']) as node from m",
    "g_contained": "select 'nation:' || n_nationkey as node, 1 as depth from nation where n_regionkey = 2 union all select 'customer:' || c_custkey, 2 from customer join nation on c_nationkey = n_nationkey where n_regionkey = 2",
    "d_overlaps": "select trim(object) as concept, count(distinct document) as n_docs, cast(sum(n) as bigint) as n_provisions from (select trim(object) object, document, count(distinct subject) n from triples where predicate in ('reg:number', 'https://norms.example/ontology#number') and trim(object) <> '' group by 1, 2) group by 1 having count(distinct document) >= 2",
    "d_compare": "select concept, case when x and y then 'shared' when x then 'a' else 'b' end as side from (select trim(object) concept, bool_or(document = 'zz-lib-00000') x, bool_or(document = 'zz-lib-00001') y from triples where predicate = 'reg:term' and trim(object) <> '' and document in ('zz-lib-00000', 'zz-lib-00001') group by 1)",
    "d_reference_clusters": r"select trim(regexp_replace(lower(ref_text), '\s+', ' ', 'g')) as target, count(*) as n, count(distinct document) as n_documents from external_refs where trim(regexp_replace(lower(ref_text), '\s+', ' ', 'g')) <> '' group by 1",
    "d_matrix": "select cast(c_nationkey as varchar) as source, " + ", ".join(f"count(*) filter (where s_nationkey = {k}) as n{k}" for k in range(25)) + " from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where s_nationkey <> c_nationkey group by 1",
    "d_margins": "select rule, cast(sum(a) as bigint) as n_out, cast(sum(b) as bigint) as n_in from (select base_version rule, 1 a, 0 b from clause_changes where base_version <> target_version union all select target_version, 0, 1 from clause_changes where base_version <> target_version) group by 1",
    "d_summary": "select document as doc, count(*) as n_triples, count(distinct subject) as n_subjects, count(*) filter (where predicate = 'rdf:type' and object = 'reg:Article') as n_articles, count(*) filter (where predicate = 'rdf:type' and object = 'reg:Chapter') as n_chapters, count(*) filter (where predicate = 'reg:references') as n_references, count(*) filter (where predicate = 'reg:term') as n_terms, count(*) filter (where predicate = 'reg:partOf') as n_parts from triples group by 1",
    "d_version_diff": "with c as (select base_version v, rule_no, clause, max(clause_title) t from clause_changes where rule_no is not null and clause is not null group by 1, 2, 3), a as (select * from c where v = '114th'), b as (select * from c where v = '115th') select rule_no, clause, case when a.v is null then 'added' when b.v is null then 'removed' else 'modified' end as change, a.t as before, b.t as after from a full join b using (rule_no, clause) where a.v is null or b.v is null or a.t is distinct from b.t",
    "v_versions": _EV + "select subject, version, valid_from, valid_until, case when valid_until is null then 'active' else 'superseded' end as status from v",
    "v_at": _EV + "select subject, version, valid_from, valid_until, case when valid_until is null then 'active' else 'superseded' end as status from v where valid_from <= timestamp '2024-01-20' and (valid_until is null or valid_until > timestamp '2024-01-20') qualify row_number() over (partition by subject order by valid_from desc, version desc) = 1",
    "v_changes": _EV + "select subject, version, valid_from as at, case when version = 1 then 'added' else 'modified' end as change, case when version > 1 then version - 1 end as previous from v where valid_from > timestamp '2024-01-10' and valid_from <= timestamp '2024-01-20'",
    "v_summary": _EV + "select case when version = 1 then 'added' else 'modified' end as change, count(*) as n, count(distinct subject) as n_subjects from v where valid_from > timestamp '2024-01-10' and valid_from <= timestamp '2024-01-20' group by 1",
    "v_durations": _EV + "select subject, min(valid_from) as proposed_at, max(valid_from) as adopted_at, cast(floor((epoch_us(max(valid_from)) - epoch_us(min(valid_from))) / 1e6) as bigint) as seconds from v group by 1 having max(valid_from) > min(valid_from)",
    "v_as_of_join": _EV + ", o as (select o_custkey user_id, o_orderkey, timestamp '2024-01-01' + to_days(cast(o_orderkey % 30 as int)) t from orders) select user_id, o_orderkey, (select max(version) from v where v.subject = o.user_id and valid_from <= o.t and (valid_until is null or o.t < valid_until)) as version from o",
    "v_timeline": "with e as (select process_uri subject, meeting_date t from meetings union all select m.process_uri, decided_at from decisions d join (select distinct uri, process_uri from meetings) m on d.meeting_uri = m.uri) select subject, min(t) as first_at, max(t) as last_at, count(*) as n_events, cast(floor((epoch_us(max(t)) - epoch_us(min(t))) / 1e6) as bigint) as span_seconds from e where t is not null group by 1",
    "v_overlapping": "with r as (select distinct speaker_uri, assignment_id, start_date s, coalesce(end_date, date '9999-12-31') e from role_assignments where start_date is not null and (end_date is null or end_date >= start_date)) select a.speaker_uri, a.assignment_id, b.assignment_id as b_assignment_id from r a join r b on a.speaker_uri = b.speaker_uri and a.assignment_id < b.assignment_id and a.s <= b.e and b.s <= a.e",
    "b_profiles": _VOTES + "select voter, count(*) as n_votes, count(*) filter (where position = 'for') as n_for, count(*) filter (where position = 'against') as n_against, count(*) filter (where position = 'abstain') as n_abstain, count(*) filter (where position = 'absent') as n_absent from v group by 1",
    "b_coalitions": _VOTES + ", p as (select vote, voter, max(position) pos, count(*) n from v group by 1, 2), t as (select voter, sum(n) n from p group by 1), s as (select a.voter a, b.voter b, count(*) k from p a join p b on a.vote = b.vote and a.pos = b.pos and a.voter < b.voter group by 1, 2) select a as voter_a, b as voter_b, k as n_shared, cast(least(x.n, y.n) as bigint) as n_votes, k / least(x.n, y.n) as rate from s join t x on a = x.voter join t y on b = y.voter where least(x.n, y.n) >= 5 and k / least(x.n, y.n) >= 0.05",
    "b_swing_voters": _VOTES + ", " + _TOPIC + "select voter, count(*) as n_topics, count(*) filter (where positions > 1) as n_varied, count(*) filter (where positions > 1) / count(*) as score from b where n >= 2 group by 1 having count(*) filter (where positions > 1) / count(*) > 0.2",
    "b_opponents": _VOTES + ", " + _TOPIC + "select voter, topic, n, against, against / n as rate from b where n >= 3 and against / n >= 0.8",
    "b_topics": _VOTES + ", p as (select vote, topic, count(*) filter (where position = 'for') f, count(*) filter (where position = 'against') a from v group by 1, 2) select topic, count(*) as n_votes, count(*) filter (where f > a) as n_adopted, count(*) filter (where f < a) as n_rejected, count(*) filter (where f + a > 0 and abs(f - a) < 0.2 * (f + a)) as n_close from p group by 1",
}
