"""Queries of reference resolution, citations, minutes, rules and identifiers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.operators import citations as cit
from normgraph.operators import deliberation as de
from normgraph.operators import extraction as ex
from normgraph.operators import minutes as mi
from normgraph.operators import resolution as res
from normgraph.sources import connectors as con
from normgraph.sources.tables import provision_graph
from normgraph.staging import stage


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _resolved(spark, d):
    lines = ex.provisions(_t(spark, d, "documents").select("doc_id", "text")).withColumn("id", F.struct("doc_id", "line_no").cast("string"))
    lines = stage(lines, "lines")
    refs = ex.references(lines.filter("level is null"), "id", "line").join(lines.select("id", "doc_id", "article", "chapter"), "id")
    refs = refs.select(F.col("doc_id").alias("doc"), F.col("article").alias("source_article"), F.col("chapter").alias("source_chapter"), "kind", "target", "identifier", "levels")
    bodies = lines.filter("article is not null and level is null").groupBy("doc_id", "article").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"))
    inner = res.split_paragraphs(bodies.withColumn("key", F.struct("doc_id", "article")), "key", "body").select("key.doc_id", "key.article", "paragraph", "point")
    there = lines.select("doc_id", "chapter", "section", "article").distinct().unionByName(inner, allowMissingColumns=True)
    return res.resolve_references(refs, there.withColumnRenamed("doc_id", "doc"))


def r_resolution(spark, d):
    """References in the corpus, resolved to provisions of their own document."""
    return _resolved(spark, d).groupBy("doc", "target", "status", "confidence").agg(F.count(F.lit(1)).alias("n"))


def r_report(spark, d):
    return res.resolution_report(_resolved(spark, d))


def r_keywords(spark, d):
    words = spark.createDataFrame([("levy", 2.0), ("permit", 1.0), ("safeguard", 3.0)], "word string, weight double")
    docs = _t(spark, d, "documents").filter("text is not null")
    return res.keyword_matches(docs, words, "doc_id", F.col("text"))


def _legal(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("See Regulation (EU) 2016/"), F.col("o_custkey").cast("string"), F.lit(" and "), (F.col("o_orderkey") % 50 + 1).cast("string"), F.lit(" U.S.C. § "), F.col("o_orderkey").cast("string"), F.lit(".")).alias("text"))


def c_citations(spark, d):
    return cit.with_identifiers(cit.citations(_legal(spark, d))).select("doc_id", "jurisdiction", "type", "urn", "address", "confidence")


def m_heads(spark, d):
    return mi.heads(_t(spark, d, "documents").select("doc_id", "text"))


def m_parts(spark, d):
    return mi.parts(_t(spark, d, "documents").select("doc_id", "text")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def m_swimlanes(spark, d):
    e = _t(spark, d, "swimlanes").dropDuplicates(["lane_id"]).select(F.explode("lane_events").alias("e")).select("e.*").dropDuplicates(["event_uri"])
    return mi.swimlanes(e, "event_type").select("lane", "place", "event_uri")


def m_rule_differences(spark, d):
    c = _t(spark, d, "clause_changes").filter("rule_no is not null and clause is not null")
    side = lambda v: c.filter(F.col("base_version") == v).groupBy(F.col("rule_no").alias("rule"), "clause").agg(F.max("base_text").alias("text"))
    return mi.rule_differences(side("114th"), side("115th")).select("rule", "clause", "change")


def x_eli(spark, d):
    g = provision_graph(spark, d)
    return con.with_eli(g.triples).filter("p like 'eli:%' or o like 'eli:%'")


def l_domains(spark, d):
    """Hosts of the addresses in the corpus, each taken as a good link."""
    url = F.explode(F.regexp_extract_all("text", F.lit(r"https?://[\w.-]+"), F.lit(0)))
    checks = _t(spark, d, "documents").select(url.alias("url"), F.lit(200).alias("code"), F.lit(None).cast("string").alias("error"))
    return con.link_report(checks)


def l_downloads(spark, d):
    return con.download_report(_t(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("doc_type", F.lit("none")).alias("status"), F.col("n_chars").alias("size")))


def t_deferrals(spark, d):
    return de.deferrals(de.agenda(_t(spark, d, "meetings")), 1)


def t_inactive(spark, d):
    return de.inactive(de.agenda(_t(spark, d, "meetings")))


def t_differences(spark, d):
    return de.meeting_differences(de.agenda(_t(spark, d, "meetings"))).groupBy("series", "change").agg(F.count(F.lit(1)).alias("n"))


def t_chains(spark, d):
    """Decisions on each meeting in order, with the state they lead to."""
    x = _t(spark, d, "decisions").select(F.lower(F.trim("meeting_uri")).alias("subject"), F.col("decided_at").alias("at"), F.col("decision_type").alias("kind")).filter("subject like 'urn:%'")
    return de.chain_statistics(de.event_chains(x, {"adoption": "adopted", "rejection": "rejected", "amendment": "amended"}))


def t_participation(spark, d):
    e = _t(spark, d, "swimlanes").dropDuplicates(["lane_id"]).select(F.explode("lane_events").alias("e")).select("e.*").dropDuplicates(["event_uri"])
    return de.participation(e)


QUERIES = {f.__name__: f for f in (t_deferrals, t_inactive, t_differences, t_chains, t_participation, r_resolution, r_report, r_keywords, c_citations, m_heads, m_parts, m_swimlanes, m_rule_differences, x_eli, l_domains, l_downloads)}

_N = "with n as (select distinct subject s, coalesce(a.predicate, t.predicate) p, object o from triples t left join attributes a on t.predicate = a.full_uri where subject <> '' and t.predicate <> '' and object <> '') "

_AGENDA = "with v as (select * from (select lower(trim(uri)) u, *, row_number() over (partition by lower(trim(uri)) order by recorded_at desc) r from meetings where uri is not null) where r = 1 and not coalesce(is_deleted, false)), m as (select *, row_number() over (partition by series order by meeting_date nulls first, u) place from v), i as (select series, u, place, unnest(agenda_items, recursive := true) from m), a as (select series, place, lower(trim(title)) topic, outcome from i where trim(title) <> '') "
_EVENTS = "with e as (select distinct on (event_uri) * from (select unnest(lane_events, recursive := true) from (select distinct on (lane_id) * from swimlanes)))"

SQL = {
    "t_deferrals": _AGENDA + "select series, topic, count(*) as n, cast(min(place) as int) as first_place, cast(max(place) as int) as last_place from a where outcome = 'deferred' group by 1, 2",
    "t_inactive": _AGENDA + ", t as (select series, topic, max(place) last_place, arg_max(outcome, row(place, outcome)) outcome from a group by 1, 2), e as (select series, max(place) z from a group by 1) select t.series, topic, cast(last_place as int) as last_place, cast(z - last_place as int) as since from t join e on t.series is not distinct from e.series where t.series is not null and z - last_place >= 3 and coalesce(outcome not in ('decided', 'withdrawn'), true)",
    "t_differences": _AGENDA + ", x as (select series, place, topic, max(outcome) o from a where series is not null group by 1, 2, 3), z as (select series, max(place) z from x group by 1), b as (select x.series, place + 1 place, topic, o from x join z using (series) where place < z), f as (select series, b.topic bt, x.topic xt, b.o bo, x.o xo from b full join (select * from x where place > 1) x using (series, place, topic)) select series, case when bt is null then 'added' when xt is null then 'removed' else 'modified' end as change, count(*) as n from f where bt is null or xt is null or bo is distinct from xo group by 1, 2",
    "t_chains": "with e as (select distinct lower(trim(meeting_uri)) subject, decided_at t, decision_type kind from decisions where starts_with(lower(trim(meeting_uri)), 'urn:') and decided_at is not null and decision_type is not null), s as (select *, case kind when 'adoption' then 'adopted' when 'rejection' then 'rejected' when 'amendment' then 'amended' end st, row_number() over (partition by subject order by t, kind) n from e) select subject, count(*) as n_steps, arg_min(kind, n) as first_kind, arg_max(kind, n) as last_kind, arg_max(st, n) filter (where st is not null) as state, cast(max(t)::date - min(t)::date as int) as days from s group by 1",
    "t_participation": _EVENTS + ", x as (select unnest(list_distinct(actors)) actor, year(ts) period, event_type from e) select actor, cast(period as int) as period, count(*) as n_events, count(distinct event_type) as n_kinds from x where trim(actor) <> '' group by 1, 2",
    "r_keywords": "with w as (select doc_id, list_distinct(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) l from documents where text is not null), h as (select doc_id, unnest([{'w': 'levy', 'x': 2.0}, {'w': 'permit', 'x': 1.0}, {'w': 'safeguard', 'x': 3.0}], recursive := true), l from w) select doc_id, count(*) as n_keywords, cast(sum(x) as double) as score from h where list_contains(l, w) group by 1",
    "c_citations": "select o_orderkey as doc_id, 'eu' as jurisdiction, 'regulation' as type, 'urn:eu:regulation:2016/' || o_custkey as urn, 'https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:32016R' || lpad(cast(o_custkey as varchar), 4, '0') as address, 1.0::double as confidence from orders union all select o_orderkey, 'us', 'usc', 'urn:us:usc:' || (o_orderkey % 50 + 1) || '/' || o_orderkey, 'https://uscode.house.gov/view.xhtml?req=granuleid:USC-prelim-title' || (o_orderkey % 50 + 1) || '-section' || o_orderkey, 1.0::double from orders",
    "m_heads": r"with l as (select doc_id, unnest(range(len(x))) n, unnest(x) as line from (select doc_id, string_split_regex(text, '\r\n|\r|\n') x from documents where text is not null)), h as (select doc_id, n, regexp_extract(trim(line), '^(\w+):\s*(.+)$', 1) field, regexp_extract(trim(line), '^(\w+):\s*(.+)$', 2) value from l) select doc_id, field, arg_min(value, n) as value from h where field in ('Date', 'Time', 'Location', 'Chair', 'Secretary', 'Present', 'Apologies', 'Absent') group by 1, 2",
    "m_parts": r"""with d as (select text from documents where text is not null), n as (select
sum(len(regexp_extract_all(text, '(?m)^\s*(?:Item\s+)?\d{1,2}[.:)]\s+[A-Z][^\n]{2,}$'))) a,
sum(len(regexp_extract_all(text, '(?m)^\s*(?:(?:Mr|Ms|Mrs|Dr|Prof)\.\s+[A-Z][\w.'' -]+?|The\s+(?:Chair|Rapporteur|Secretariat)|[A-Z][A-Z'' -]{2,40})(?:\s+\([^)]+\))?:\s+\S[^\n]*'))) b,
sum(len(regexp_extract_all(text, '(?i)\b(?:it\s+was\s+)?(?:decided|agreed|resolved|adopted|approved|rejected|deferred)\b\s*(?:that|to|on|:)?\s*[^\n.]{3,}'))) c,
sum(len(regexp_extract_all(text, '(?i)\baction(?:\s+item)?s?\s*:\s*[^\n]+'))) e,
sum(len(regexp_extract_all(text, '(?i)\b\d+\s+(?:votes?\s+)?(?:in\s+favou?r|for)\b[^\d\n]{1,20}\d+\s+(?:votes?\s+)?against\b(?:[^\d\n]{1,20}\d+\s+abst\w*)?'))) f from d)
select kind, cast(k as bigint) as n from (select unnest(['agenda', 'speaker', 'decision', 'action', 'vote']) kind, unnest([a, b, c, e, f]) k from n) where k > 0""",
    "m_swimlanes": "with e as (select distinct on (event_uri) event_uri, ts, event_type from (select unnest(lane_events, recursive := true) from (select distinct on (lane_id) * from swimlanes)) ) select event_type as lane, cast(row_number() over (partition by event_type order by ts, event_uri) as int) as place, event_uri from e where trim(event_type) <> ''",
    "m_rule_differences": "with c as (select base_version v, rule_no as rule, clause, max(base_text) t from clause_changes where rule_no is not null and clause is not null group by 1, 2, 3), a as (select * from c where v = '114th'), b as (select * from c where v = '115th') select rule, clause, case when a.v is null then 'added' when b.v is null then 'removed' else 'modified' end as change from a full join b using (rule, clause) where a.v is null or b.v is null or a.t is distinct from b.t",
    "x_eli": _N
    + """, c(k, v) as (values ('reg:Regulation', 'eli:LegalResource'), ('reg:Directive', 'eli:LegalResource'), ('reg:Decision', 'eli:LegalResource'), ('reg:Chapter', 'eli:LegalResourceSubdivision'), ('reg:Section', 'eli:LegalResourceSubdivision'), ('reg:Article', 'eli:LegalResourceSubdivision'), ('reg:Paragraph', 'eli:LegalResourceSubdivision'), ('reg:Point', 'eli:LegalResourceSubdivision'), ('reg:Preamble', 'eli:LegalResourceSubdivision'), ('reg:Recital', 'eli:LegalResourceSubdivision')),
x(k, v) as (values ('reg:title', 'eli:title'), ('reg:number', 'eli:id_local'), ('reg:identifier', 'eli:id_local'), ('reg:partOf', 'eli:is_part_of'), ('reg:contains', 'eli:has_part'), ('reg:date', 'eli:date_document'), ('reg:version', 'eli:version'), ('reg:references', 'eli:cites'), ('reg:referencedBy', 'eli:cited_by'))
select s, p, v as o from n join c on n.o = c.k where p = 'rdf:type' union select s, v, o from n join x on n.p = x.k union select s, p, o from n where p like 'eli:%' or o like 'eli:%'""",
    "l_domains": r"select regexp_replace(lower(regexp_extract(u, '://([^/:?#]+)', 1)), '^www\.', '') as domain, count(*) as n, count(*) as n_ok, 1.0::double as rate from (select unnest(regexp_extract_all(text, 'https?://[\w.-]+')) u from documents) group by 1",
    "l_downloads": "select source, status, count(*) as n, cast(sum(n_chars) as bigint) as bytes from (select coalesce(source, 'none') source, coalesce(doc_type, 'none') status, n_chars from documents) group by rollup (source, status)",
}
