"""Queries of named graphs, versions, activity, templates and scalar functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.functions import text as fn
from normgraph.operators import activity as act
from normgraph.operators import citations as cit
from normgraph.operators import deliberation as de
from normgraph.operators import extraction as ex
from normgraph.operators import minutes as mi
from normgraph.operators import resolution as res
from normgraph.operators import temporal as tm
from normgraph.operators import traversal as walk
from normgraph.operators import versions as ver
from normgraph.operators import voting
from normgraph.operators.graph import TripleGraph
from normgraph.plans.templates import render
from normgraph.sources.tables import provision_graph, relational_graph


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _at(day: str):
    return F.lit(day).cast("timestamp")


# SPARQL


def _sparql(text: str, tables: tuple[str, ...]):
    return lambda spark, d: relational_graph(spark, d, tables).query(text)


def _template(name: str, **values):
    return lambda spark, d: provision_graph(spark, d).query(render(name, **values))


SPARQL = {
    "s_sums": _sparql("SELECT ?nation (COUNT(*) AS ?n) (SUM(?size) AS ?total) (AVG(?size) AS ?mean) WHERE { ?nation t:brand ?b ; t:size ?size . } GROUP BY ?nation", ("part",)),
    "s_distinct_sums": _sparql("SELECT ?b (SUM(DISTINCT ?size) AS ?total) (AVG(DISTINCT ?size) AS ?mean) (MIN(DISTINCT ?size) AS ?low) WHERE { ?p t:brand ?b ; t:size ?size . } GROUP BY ?b", ("part",)),
    "s_count_all": _sparql("SELECT (COUNT(*) AS ?n) WHERE { ?s t:nation nation:999 }", ("customer",)),
    "s_str": _sparql('SELECT ?n ?name WHERE { ?n t:name ?name . FILTER(CONTAINS(STR(?n), "nation:1")) }', ("nation",)),
    "s_chained_optional": _sparql("SELECT ?c ?n ?r WHERE { ?c t:segment \"MACHINERY\" . OPTIONAL { ?c t:nation ?n . FILTER(STRENDS(?n, \"7\")) } OPTIONAL { ?n t:region ?r } }", ("region", "nation", "customer")),
    "l_articles": _template("articles"),
    "l_chapters": _template("chapters"),
    "l_references": _template("most-referenced"),
    "l_search": _template("search", word="a"),
    "l_article_refs": _template("article-refs", article="urn:"),
    "l_describe": lambda spark, d: provision_graph(spark, d).query("DESCRIBE ?x WHERE { ?x reg:number \"536\" }"),
}


# graphs


def g_point(spark, d):
    """All values of one subject, one list a predicate."""
    return relational_graph(spark, d, ("nation", "region")).properties("nation:3").select("p", F.array_join("objects", "|").alias("objects"))


def g_least(spark, d):
    return provision_graph(spark, d).triples.groupBy("s", "p").agg(F.min("o").alias("o"))


def g_domains(spark, d):
    """Distinct subjects, predicates and objects of the library."""
    g = provision_graph(spark, d)
    parts = [getattr(g, n)().select(F.lit(n).alias("domain"), F.col(n[0]).alias("value")) for n in ("subjects", "predicates", "objects")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def g_nodes(spark, d):
    """Nodes of an export with their types and labels."""
    return relational_graph(spark, d, ("nation", "region")).nodes_and_edges(("t:region",))[0]


def g_subgraph_edges(spark, d):
    return walk.subgraph(relational_graph(spark, d, ("region", "nation", "supplier")), "region:1", 1)[1]


def g_cycles(spark, d):
    """Institutions whose parents run in a loop, with the greatest of the loop."""
    i = _t(spark, d, "institutions").select(F.upper(F.trim("id")).alias("x"), F.upper(F.trim("parent")).alias("y"))
    return walk.loops(i.filter("x <> '' and y <> ''"))


def g_search(spark, d):
    labels = relational_graph(spark, d, ("nation", "region")).labels(("t:name",))
    return act.node_search(labels, "1", 12)


def g_neighbours(spark, d):
    return act.neighbours(relational_graph(spark, d, ("nation", "region", "supplier")).triples, "nation:3")


def g_top_predicates(spark, d):
    return provision_graph(spark, d).counts("p").orderBy(F.desc("n"), "p").limit(10)


def c_fetch_plan(spark, d):
    """The ten documents most referred to that an address is known for and that are no known instrument."""
    refs = _t(spark, d, "external_refs").filter("trim(ref_text) <> ''").select(F.lower(F.trim("ref_text")).alias("target"))
    known = _t(spark, d, "instruments").select(F.lower(F.trim("citation")).alias("target"))
    address = F.concat(F.lit("https://instruments.example/"), fn.slug(F.col("target")))
    return act.fetch_plan(refs, address, ("instruments.example",), known, 10)


def c_documents(spark, d):
    """Citations in the corpus by place."""
    return cit.citations(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", "jurisdiction", "type", F.array_join("parts", "/").alias("parts"), "start")


# time


def _quads(spark, d):
    """Triples of the library, each in a graph of its document."""
    return _t(spark, d, "triples").filter("subject <> '' and predicate <> '' and object <> ''").select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"), F.when(F.col("document") != "zz-lib-00000", F.col("document")).alias("g"), "recorded_at")


def _graphs(spark, d):
    return _quads(spark, d).filter("g is not null").groupBy(F.col("g").alias("name")).agg(F.min("recorded_at").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"), (F.max("recorded_at") < _at("2018-01-01")).alias("is_deleted"), F.max("recorded_at").alias("at"))


def v_graph_list(spark, d):
    return tm.graph_list(_graphs(spark, d)).select("name", "valid_from")


def v_graph_stats(spark, d):
    return tm.graph_stats(_quads(spark, d), _graphs(spark, d))


def v_graph_at(spark, d):
    return tm.triples_at(_quads(spark, d), _graphs(spark, d), _at("2016-06-01")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def _versions(spark, d):
    """Versions of meetings, one per delivery."""
    m = _t(spark, d, "meetings").select(F.lower(F.trim("uri")).alias("subject"), "recorded_at").dropna().distinct()
    return ver.version_history(m, "subject", "recorded_at", "recorded_at")


def v_state(spark, d):
    """Versions of meetings from a log: added, superseded by the next one and linked with the one before."""
    v = _versions(spark, d)
    text = lambda c: c.cast("string")
    entry = lambda action, value, when: F.struct(action.alias("action"), value.alias("value"), when.alias("when"))
    none, when = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    log = v.select(F.col("valid_from").alias("at"), "subject", text(F.col("version")).alias("version"), F.explode(F.array(entry(F.lit("add"), none, F.col("valid_from")), entry(F.lit("link"), F.when(F.col("version") > 1, text(F.col("version") - 1)), when), entry(F.when(F.col("valid_until").isNotNull(), "supersede"), text(F.col("version") + 1), F.col("valid_until")))).alias("e")).select("at", "subject", "version", "e.*").filter("action is not null")
    return tm.version_state(log)


def v_in_force(spark, d):
    return tm.in_force(_versions(spark, d).withColumn("status", F.lit("active")), _at("2018-06-01")).select("subject", "version", "valid_from")


def v_as_of(spark, d):
    """Decisions on meetings that had been delivered by a day."""
    rows = _t(spark, d, "decisions").select("row_id", F.lower(F.trim("meeting_uri")).alias("meeting")).filter("meeting is not null")
    return ver.as_of(rows, _versions(spark, d), _at("2018-06-01"), ["meeting"]).select("row_id", "meeting")


def v_between(spark, d):
    """Changes in a year to the meetings that decisions name."""
    rows = _t(spark, d, "decisions").select(F.lower(F.trim("meeting_uri")).alias("meeting"))
    return tm.changed_bindings(rows, _versions(spark, d), _at("2018-01-01"), _at("2019-01-01"), ["meeting"]).select("subject", "version", "at", "change", "previous")


def v_between_meetings(spark, d):
    m = _t(spark, d, "meetings").select(F.lower(F.trim("uri")).alias("uri"), "meeting_date")
    return tm.changes_between_meetings(_versions(spark, d), m, "urn:delib:meeting:m0000005", "urn:delib:meeting:m0000044").select("subject", "version", "at", "change")


def v_adopted(spark, d):
    return tm.adopted_between(_t(spark, d, "decisions"), _at("2015-01-01"), _at("2020-01-01"))


def v_stats(spark, d):
    return tm.temporal_stats(_versions(spark, d))


def v_mean_duration(spark, d):
    return ver.mean_duration(_versions(spark, d)).select(F.round("mean_seconds", 3).alias("mean_seconds"), "n")


def v_compare(spark, d):
    """Predicates in which two subjects of the library differ, the two least ones."""
    t = provision_graph(spark, d).triples
    a, b = (r[0] for r in t.select("s").distinct().orderBy("s").limit(2).collect())
    return ver.compare_versions(t, a, b)


# activity


def t_overdue(spark, d):
    m = de.last_versions(_t(spark, d, "meetings"), "uri")
    return act.overdue(m, "meeting_date", "status", F.lit("2020-01-01").cast("date")).select("uri", "days_over")


def t_blocked(spark, d):
    """Decisions that supersede others which are neither adopted nor rejected."""
    x = de.last_versions(_t(spark, d, "decisions").drop("row_id"), "uri")
    items = x.select(F.col("uri").alias("item"), F.lower("decision_type").alias("kind"))
    links = x.select(F.col("uri").alias("item"), F.lower(F.trim("supersedes_uri")).alias("on"))
    return act.blocked(items, links, F.col("kind").isin("adoption", "rejection"))


def t_quorum(spark, d):
    """Events with fewer than three different actors."""
    e = _t(spark, d, "swimlanes").dropDuplicates(["lane_id"]).select(F.explode("lane_events").alias("e")).select("e.*").dropDuplicates(["event_uri"])
    n = e.select("event_uri", F.size(F.array_distinct(F.filter("actors", lambda x: F.trim(x) != ""))).alias("present")).filter("present >= 0")
    return act.below_quorum(n, "present", F.lit(3)).select("event_uri", "missing")


def t_evolution(spark, d):
    """Decisions by kind and series of meetings."""
    x = _t(spark, d, "decisions").select(F.lower(F.trim("agenda_item_uri")).alias("provision"), F.lower("decision_type").alias("kind"), F.col("decided_at").alias("at"), F.lit("").alias("by")).filter("provision like 'urn:%' and kind is not null")
    up = x.select(F.col("provision").alias("node"), F.regexp_extract("provision", r"^(.*)/item/", 1).alias("parent")).filter("parent <> ''").distinct()
    return act.evolution(x, up)


def b_network(spark, d):
    from normgraph.queries_graph import _votes

    v = _votes(spark, d)
    return act.network(voting.coalitions(v, 0.3, 5), voting.voter_profiles(v))[0]


def m_speakers(spark, d):
    return act.speakers(_t(spark, d, "documents").select("doc_id", "text"))


def m_bodies(spark, d):
    return act.bodies(_t(spark, d, "documents").select("doc_id", "text"), ("Council", "Committee", "Commission", "Ministry"))


def m_bill_changes(spark, d):
    """Amendments between versions of clauses written as a bill."""
    c = _t(spark, d, "clause_changes").filter("clause_title <> '' and rule_no <> ''").dropDuplicates(["change_id"])
    text = F.concat(F.lit("SEC. 1. CHANGES.\nSection "), F.col("change_id").cast("string"), F.lit(' is amended by striking "'), F.regexp_replace("clause_title", '["\n]', " "), F.lit('" and inserting "'), F.regexp_replace("rule_no", '["\n]', " "), F.lit('".'))
    return mi.bill_changes(c.select("change_id", text.alias("text")), "change_id").select("change_id", "section", "kind", "target", "old", "new")


def m_affected(spark, d):
    """Instruments that decisions of the corpus amend, and how many provisions refer to each."""
    refs = _t(spark, d, "external_refs").filter("ref_text is not null").select(F.concat_ws("#", "document", "provision").alias("source"), F.lower(F.trim("ref_text")).alias("target"))
    changes = _t(spark, d, "instruments").select(F.lower(F.trim("citation")).alias("target"), F.when(F.col("is_deleted"), "repeal").otherwise("replace").alias("kind"))
    return mi.affected(changes, refs)


def m_narrowed(spark, d):
    """Clauses that a version narrows or widens."""
    c = _t(spark, d, "clause_changes").dropDuplicates(["change_id"])
    return mi.narrowed(c, ("change_id",), "base_text", "target_text")


def m_orphaned(spark, d):
    """Provisions that refer to instruments which are deleted."""
    refs = _t(spark, d, "external_refs").filter("ref_text is not null").select(F.concat_ws("#", "document", "provision").alias("source"), F.lower(F.trim("ref_text")).alias("target"))
    gone = _t(spark, d, "instruments").filter("is_deleted").select(F.lower(F.trim("citation")).alias("target"), F.lit("repeal").alias("kind"))
    return mi.orphaned(gone, refs)


# matching


def r_mentions(spark, d):
    m = _t(spark, d, "meetings").select(F.col("series").alias("mention"))
    a = _t(spark, d, "meetings").select(F.lower("series").alias("entity"), F.concat(F.col("series"), F.lit(" sitting")).alias("alias"))
    return res.match_mentions(m, a, 0.5)


def r_scenario(spark, d):
    p = _t(spark, d, "clause_changes").filter("clause_title is not null").groupBy(F.concat_ws("/", "rule_no", "clause").alias("id")).agg(F.max("clause_title").alias("text"))
    refs = p.select(F.col("id").alias("source"), F.concat(F.split_part("id", F.lit("/"), F.lit(1)), F.lit("/1")).alias("target"))
    direct = p.filter(F.col("id").isin("XI/17", "I/1", "II/1")).select("id", F.lit(0.9).alias("score"))
    words = spark.createDataFrame([("shehechi",), ("dadaze",)], "word string")
    return res.scenario_matches(p, refs, direct, words).select("id", "relevance", F.round("score", 6).alias("score"))


def e_paragraphs(spark, d):
    rows = res.split_paragraphs(_t(spark, d, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id", "paragraph").agg(F.count(F.lit(1)).alias("n"))


# functions


def f_snippets(spark, d):
    c = _t(spark, d, "documents").filter("text is not null").select("doc_id", "text", (F.instr("text", "shall") - 1).alias("at")).filter("at >= 0")
    return c.select("doc_id", fn.snippet(F.col("text"), F.col("at"), F.col("at") + 5).alias("snippet"))


def f_formats(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 977).alias("n"))
    return o.select("o_orderkey", fn.bytes_text(F.col("n")).alias("size"), fn.thousands(F.col("n")).alias("number"), fn.seconds_text(F.col("o_orderkey") % 100_000).alias("time"))


def f_relative_days(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey")
    said = F.element_at(F.array(F.lit("tomorrow"), F.lit("next week"), F.concat(F.lit("in "), (F.col("o_orderkey") % 9).cast("string"), F.lit(" days")), F.lit("2 weeks ago"), F.lit("soon")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select("o_orderkey", fn.relative_day(said, F.lit("2024-02-28").cast("date")).alias("day"))


def f_clause_order(spark, d):
    """Clauses of each rule in order of their numbers."""
    c = _t(spark, d, "clause_changes").select("rule_no", "clause").dropna().distinct()
    k = fn.clause_order(F.col("clause"))
    return c.groupBy("rule_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), "clause"))), lambda x: x["clause"]), " ").alias("clauses"))


def f_articles(spark, d):
    return _t(spark, d, "external_refs").select("row_id", fn.article_number(F.concat(F.col("document"), F.lit(":"), F.col("provision"))).alias("article"))


QUERIES = SPARQL | {f.__name__: f for f in (g_point, g_least, g_domains, g_nodes, g_subgraph_edges, g_cycles, g_search, g_neighbours, g_top_predicates, c_fetch_plan, c_documents, v_graph_list, v_graph_stats, v_graph_at, v_state, v_in_force, v_as_of, v_between, v_between_meetings, v_adopted, v_stats, v_mean_duration, v_compare, t_overdue, t_blocked, t_quorum, t_evolution, b_network, m_speakers, m_bodies, m_bill_changes, m_affected, m_narrowed, m_orphaned, r_mentions, r_scenario, e_paragraphs, f_snippets, f_formats, f_relative_days, f_clause_order, f_articles)}

_N = "with n as (select distinct subject s, coalesce(a.predicate, t.predicate) p, object o from triples t left join attributes a on t.predicate = a.full_uri where subject <> '' and t.predicate <> '' and object <> '') "
_NAT = "with t as (select 'nation:' || n_nationkey s, 'rdf:type' p, 't:Nation' o from nation union all select 'nation:' || n_nationkey, 't:name', n_name from nation union all select 'nation:' || n_nationkey, 't:region', 'region:' || n_regionkey from nation union all select 'region:' || r_regionkey, 'rdf:type', 't:Region' from region union all select 'region:' || r_regionkey, 't:name', r_name from region"
_SUP = " union all select 'supplier:' || s_suppkey, 'rdf:type', 't:Supplier' from supplier union all select 'supplier:' || s_suppkey, 't:name', s_name from supplier union all select 'supplier:' || s_suppkey, 't:nation', 'nation:' || s_nationkey from supplier union all select 'supplier:' || s_suppkey, 't:balance', cast(s_acctbal as varchar) from supplier"
_Q = "with q as (select subject s, predicate p, object o, case when document <> 'zz-lib-00000' then document end g, recorded_at t from triples where subject <> '' and predicate <> '' and object <> ''), l as (select g as name, min(t) f, max(t) z from q where g is not null group by 1 having max(t) >= timestamp '2018-01-01') "
_V = "with d as (select distinct lower(trim(uri)) subject, recorded_at t from meetings where uri is not null and recorded_at is not null), v as (select subject, row_number() over w as version, t valid_from, lead(t) over w valid_until from d window w as (partition by subject order by t)) "
_LAST = "x as (select * from (select lower(trim(uri)) u, *, row_number() over (partition by lower(trim(uri)) order by recorded_at desc, {tie}) r from {t} where uri is not null) where r = 1 and not coalesce(is_deleted, false)) "
_EV = "e as (select distinct on (event_uri) * from (select unnest(lane_events, recursive := true) from (select distinct on (lane_id) * from swimlanes)))"
_VOTES = "with v as (select strftime(ts, '%Y-%m-%d %H') vote, hour(ts) topic, user_id voter, ['for', 'for', 'against', 'abstain', 'absent'][((event_id + user_id) % 5) + 1] as position from events) "

SQL = {
    "s_sums": "select 'part:' || p_partkey as nation, count(*) as n, cast(sum(p_size) as double) as total, cast(avg(p_size) as double) as mean from part where p_brand is not null and p_size is not null group by 1",
    "s_distinct_sums": "select p_brand as b, cast(sum(distinct p_size) as double) as total, cast(avg(distinct p_size) as double) as mean, cast(min(p_size) as varchar) as low from part group by 1",
    "s_count_all": "select count(*) as n from customer where c_nationkey = 999 having count(*) > 0",
    "s_str": "select 'nation:' || n_nationkey as n, n_name as name from nation where starts_with(cast(n_nationkey as varchar), '1')",
    "s_chained_optional": "select 'customer:' || c_custkey as c, coalesce(case when c_nationkey % 10 = 7 then 'nation:' || c_nationkey end, 'nation:' || n_nationkey) as n, 'region:' || n_regionkey as r from customer join nation on (c_nationkey % 10 = 7 and n_nationkey = c_nationkey) or c_nationkey % 10 <> 7 where c_mktsegment = 'MACHINERY'",
    "l_articles": _N + "select a.s as x, b.o as title from n a join n b on a.s = b.s where a.p = 'rdf:type' and a.o = 'reg:Article' and b.p = 'reg:title'",
    "l_chapters": _N + "select a.s as x, b.o as title from n a join n b on a.s = b.s where a.p = 'rdf:type' and a.o = 'reg:Chapter' and b.p = 'reg:title'",
    "l_references": _N + "select o as \"to\", count(*) as n from n where p = 'reg:references' group by 1",
    "l_search": _N + "select a.s as x, b.o as title from n a join n b on a.s = b.s where a.p = 'rdf:type' and a.o = 'reg:Article' and b.p = 'reg:title' and contains(b.o, 'a')",
    "l_article_refs": _N + "select a.s as x, b.o as title from n a join n b on a.s = b.s where a.p = 'reg:references' and contains(a.o, 'urn:') and b.p = 'reg:title'",
    "l_describe": _N + ", x as (select s from n where p = 'reg:number' and o = '536') select s, p, o from n where s in (select s from x) or o in (select s from x)",
    "g_point": "select unnest(['rdf:type', 't:name', 't:region']) as p, unnest(['t:Nation', n_name, 'region:' || n_regionkey]) as objects from nation where n_nationkey = 3",
    "g_least": _N + "select s, p, min(o) as o from n group by 1, 2",
    "g_domains": _N + "select distinct 'subjects' as domain, s as value from n union all select distinct 'predicates', p from n union all select distinct 'objects', o from n",
    "g_nodes": "select 'nation:' || n_nationkey as id, 'Nation' as type, cast(n_nationkey as varchar) as label from nation union all select distinct 'region:' || r_regionkey, 'Region', cast(r_regionkey as varchar) from region join nation on n_regionkey = r_regionkey",
    "g_subgraph_edges": _NAT + _SUP + "), k as (select 'region:1' k union select o from t where s = 'region:1' union select s from t where o = 'region:1') select s, p, o from t where s in (select k from k) and o in (select k from k)",
    "g_cycles": "with recursive e as (select distinct upper(trim(id)) x, upper(trim(parent)) y from institutions where trim(id) <> '' and trim(parent) <> ''), r(x, y) as (select x, y from e union select r.x, e.y from r join e on r.y = e.x) select a.x as node, max(a.y) as loop from r a join r b on a.y = b.x and b.y = a.x where exists (select 1 from r c where c.x = a.x and c.y = a.x) group by 1",
    "g_search": "with l as (select 'nation:' || n_nationkey s, n_name as label from nation union all select 'region:' || r_regionkey, r_name from region) select s, label, case when lower(label) = '1' then 0 when starts_with(lower(label), '1') then 1 else 2 end as rank from l where contains(lower(label), '1') or contains(s, '1') order by 3, 2, 1 limit 12",
    "g_neighbours": _NAT + _SUP + ") select 'out' as direction, p, o as node from t where s = 'nation:3' union select 'in', p, s from t where o = 'nation:3'",
    "g_top_predicates": _N + "select p, count(*) as n from n group by 1 order by 2 desc, 1 limit 10",
    "c_fetch_plan": r"with r as (select lower(trim(ref_text)) target, count(*) n from external_refs where trim(ref_text) <> '' group by 1) select target, 'https://instruments.example/' || regexp_replace(regexp_replace(target, '[\s-]+', '_', 'g'), '[^a-z0-9_]', '', 'g') as address, n from r where target not in (select lower(trim(citation)) from instruments where citation is not null) order by n desc, target limit 10",
    "c_documents": r"with m as (select doc_id, text, unnest(regexp_extract_all(text, '\b(?:Regulation|Reg\.)\s+\([A-Z]{2}\)\s+(?:No\.?\s+)?\d+/\d+')) x from documents), k as (select doc_id, text, x, row_number() over (partition by doc_id, x) i from m) select doc_id, 'eu' as jurisdiction, 'regulation' as type, regexp_extract(x, '(\d+/\d+)$', 1) as parts, list_sum([length(p) for p in list_slice(string_split(text, x), 1, i)]) + (i - 1) * length(x) as start from k",
    "v_graph_list": _Q + "select name, f as valid_from from l",
    "v_graph_stats": _Q + "select l.name, count(distinct (s, p, o)) as n_triples from l join q on q.g = l.name group by 1 union all select '', count(distinct (s, p, o)) from q where g is null having count(*) > 0",
    "v_graph_at": _Q + ", w as (select distinct s, p, o from q where g is null or g in (select name from l where f <= timestamp '2016-06-01')) select p, count(*) as n from w group by 1",
    "v_state": _V + "select subject, cast(version as varchar) as version, valid_from, valid_until, case when valid_until is null then 'active' else 'superseded' end as status, case when version > 1 then cast(version - 1 as varchar) end as previous, case when valid_until is not null then cast(version + 1 as varchar) end as next from v",
    "v_in_force": _V + "select subject, version, valid_from from v where valid_from <= timestamp '2018-06-01' and (valid_until is null or valid_until > timestamp '2018-06-01')",
    "v_as_of": _V + ", r as (select row_id, lower(trim(meeting_uri)) meeting from decisions where meeting_uri is not null) select row_id, meeting from r where meeting not in (select subject from v) or meeting in (select subject from v where valid_from <= timestamp '2018-06-01' and (valid_until is null or valid_until > timestamp '2018-06-01'))",
    "v_between": _V + "select subject, version, valid_from as at, case when version = 1 then 'added' else 'modified' end as change, case when version > 1 then version - 1 end as previous from v where valid_from > timestamp '2018-01-01' and valid_from <= timestamp '2019-01-01' and subject in (select lower(trim(meeting_uri)) from decisions)",
    "v_between_meetings": _V + ", m as (select max(meeting_date) filter (where lower(trim(uri)) = 'urn:delib:meeting:m0000005') a, max(meeting_date) filter (where lower(trim(uri)) = 'urn:delib:meeting:m0000044') b from meetings) select subject, version, valid_from as at, case when version = 1 then 'added' else 'modified' end as change from v, m where valid_from > a and valid_from <= b",
    "v_adopted": "select lower(trim(uri)) as uri, max(row(decided_at, title))[2] as title, max(decided_at) as decided_at from decisions where lower(trim(decision_type)) = 'amendment' and decided_at > timestamp '2015-01-01' and decided_at <= timestamp '2020-01-01' and uri is not null group by 1",
    "v_stats": _V + "select case when valid_until is null then 'active' else 'superseded' end as status, count(*) as n_versions, count(distinct subject) as n_subjects, min(valid_from) as first_from, max(valid_from) as last_from from v group by 1",
    "v_mean_duration": _V + ", x as (select floor((epoch_us(max(valid_from)) - epoch_us(min(valid_from))) / 1e6) k from v group by subject having max(valid_from) > min(valid_from)) select round(avg(k), 3) as mean_seconds, count(*) as n from x",
    "v_compare": _N + ", k as (select min(s) a, (select min(s) from n where s > (select min(s) from n)) b from n), x as (select p, max(o) filter (where s = a) old, max(o) filter (where s = b) as \"new\" from n, k where s in (a, b) group by 1) select p, case when old is null then 'added' when \"new\" is null then 'removed' else 'modified' end as change, old, \"new\" from x where old is distinct from \"new\"",
    "t_overdue": "with " + _LAST.format(t="meetings", tie="1") + "select u as uri, cast(date_diff('day', meeting_date::date, date '2020-01-01') as int) as days_over from x where date_diff('day', meeting_date::date, date '2020-01-01') >= 7 and coalesce(lower(trim(status)) not in ('completed', 'cancelled'), true)",
    "t_blocked": "with " + _LAST.format(t="decisions", tie="identifier desc nulls last, title desc nulls last, decision_type desc nulls last") + "select a.u as item, count(distinct b.u) as n_blockers from x a join x b on lower(trim(a.supersedes_uri)) = b.u where coalesce(lower(b.decision_type) not in ('adoption', 'rejection'), true) group by 1",
    "t_quorum": "with " + _EV + ", n as (select event_uri, len(list_distinct(list_filter(actors, lambda a: trim(a) <> ''))) k from e where actors is not null) select event_uri, cast(3 - k as int) as missing from n where k < 3",
    "t_evolution": r"with d as (select lower(trim(agenda_item_uri)) p, lower(decision_type) kind, decided_at t from decisions where starts_with(lower(trim(agenda_item_uri)), 'urn:') and decision_type is not null) select case when regexp_extract(p, '^(.*)/item/', 1) <> '' then regexp_extract(p, '^(.*)/item/', 1) else p end as chapter, kind, count(*) as n, count(distinct p) as n_provisions, min(t) as first_at, max(t) as last_at from d group by 1, 2",
    "b_network": _VOTES + ", p as (select vote, voter, max(position) pos, count(*) n from v group by 1, 2), t as (select voter, sum(n) n from p group by 1), s as (select a.voter a, b.voter b, count(*) k from p a join p b on a.vote = b.vote and a.pos = b.pos and a.voter < b.voter group by 1, 2), e as (select a, b from s join t x on a = x.voter join t y on b = y.voter where least(x.n, y.n) >= 5 and k / least(x.n, y.n) >= 0.3), g as (select u, count(*) c from (select a u from e union all select b from e) group by 1) select voter as id, cast(n as bigint) as n_votes, coalesce(c, 0) as degree from t left join g on voter = u",
    "m_speakers": r"with m as (select doc_id, unnest(regexp_extract_all(text, '\b(?:Mr|Ms|Mrs|Dr|Prof|Amb)\.\s+[A-Z][\w''’-]+(?:[ \t]+[A-Z][\w''’-]+){0,3}')) x from documents) select doc_id, trim(regexp_replace(regexp_replace(x, '^\w+\.\s+', ''), '\s+', ' ', 'g')) as name, regexp_extract(x, '^(\w+)', 1) as title, count(*) as n from m group by 1, 2, 3",
    "m_bodies": r"with m as (select doc_id, unnest(regexp_extract_all(text, '\b(?:Council|Committee|Commission|Ministry)[ \t]+(?:of|for|on)[ \t]+(?:the[ \t]+)?[A-Z]\w+(?:[ \t]+[A-Z]\w+){0,3}')) x from documents) select doc_id, x as body, count(*) as n from m group by 1, 2",
    "m_bill_changes": r"""select change_id, '1' as section, 'strike_insert' as kind, cast(change_id as varchar) as target, regexp_replace(clause_title, '["\n]', ' ', 'g') as old, regexp_replace(rule_no, '["\n]', ' ', 'g') as "new" from (select distinct on (change_id) * from clause_changes where clause_title <> '' and rule_no <> '')""",
    "m_affected": "with r as (select lower(trim(ref_text)) target, count(distinct concat_ws('#', document, provision)) n from external_refs where ref_text is not null group by 1), c as (select distinct lower(trim(citation)) target, case when is_deleted then 'repeal' else 'replace' end kind from instruments) select c.target, kind, coalesce(n, 0) as n_referring from c left join r on c.target = r.target",
    "m_narrowed": "with c as (select distinct on (change_id) change_id, lower(coalesce(base_text, '')) a, lower(coalesce(target_text, '')) b from clause_changes), p as (select unnest(['except when', 'except where', 'except in cases', 'unless', 'provided that', 'subject to', 'limited to', 'only if', 'only when', 'only where', 'shall not apply', 'does not apply', 'notwithstanding', 'restricted to']) w), x as (select change_id, string_agg(w, ', ' order by w) filter (where contains(b, w) and not contains(a, w)) n, count(*) filter (where contains(a, w) and not contains(b, w)) g from c, p group by 1) select change_id, coalesce(n, '') as added, case when n is not null then 'narrowing' else 'expansion' end as change from x where n is not null or g > 0",
    "m_orphaned": "select distinct lower(trim(ref_text)) as target, concat_ws('#', document, provision) as source from external_refs where lower(trim(ref_text)) in (select lower(trim(citation)) from instruments where is_deleted)",
    "r_mentions": r"with s as (select distinct series m from meetings where series is not null), w as (select m, list_filter(string_split_regex(lower(trim(m)), '\s+'), lambda x: x <> '') l from s), p as (select a.m m, lower(b.m) entity, list_concat(b.l, ['sitting']) x, a.l y from w a join w b on len(list_intersect(a.l, list_concat(b.l, ['sitting']))) > 0), k as (select m, entity, len(list_filter(y, lambda z: list_contains(x, z))) c, len(x) nx, len(y) ny from p), f as (select m, entity, c / (nx + ny - c) s from k where c / (nx + ny - c) >= 0.5) select m as mention, arg_min(entity, row(-s, entity)) as entity, max(s) as score from f group by 1",
    "f_snippets": r"with c as (select doc_id, text, instr(text, 'shall') - 1 a from documents where instr(text, 'shall') > 0) select doc_id, case when a > 50 then '…' else '' end || regexp_replace(regexp_replace(substr(text, greatest(a - 50, 0) + 1, least(a + 55, length(text)) - greatest(a - 50, 0)), '\s+', ' ', 'g'), '^ | $', '', 'g') || case when a + 55 < length(text) then '…' else '' end as snippet from c",
    "f_formats": "with o as (select o_orderkey, o_orderkey * 977 n, o_orderkey % 100000 s from orders) select o_orderkey, case when n >= 1073741824 then printf('%.1f GB', round(n / 1073741824, 1)) when n >= 1048576 then printf('%.1f MB', round(n / 1048576, 1)) when n >= 1024 then printf('%.1f KB', round(n / 1024, 1)) else n || ' B' end as size, format('{:,}', n) as number, case when s >= 3600 then printf('%dh %02dm %02ds', s // 3600, s % 3600 // 60, s % 60) when s >= 60 then printf('%dm %02ds', s // 60, s % 60) else printf('%ds', s) end as time from orders join o using (o_orderkey)",
    "f_relative_days": "select o_orderkey, case o_orderkey % 5 when 0 then date '2024-02-29' when 1 then date '2024-03-06' when 2 then date '2024-02-28' + cast(o_orderkey % 9 as int) when 3 then date '2024-02-14' end as day from orders",
    "f_clause_order": r"with c as (select distinct rule_no, clause from clause_changes where rule_no is not null and clause is not null) select rule_no, string_agg(clause, ' ' order by coalesce(try_cast(regexp_extract(clause, '^(\d+)', 1) as bigint), 4611686018427387904), regexp_extract(clause, '^\d*(.*)$', 1), clause) as clauses from c group by 1",
    "f_articles": r"select row_id, try_cast(regexp_extract(document || ':' || provision, ':Art(\d+)', 1) as int) as article from external_refs",
}
