"""Queries of text extraction, exports and streams over the corpus and the clause changes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.functions import text as fn
from normgraph.operators import extraction as ex
from normgraph.sources import rdf
from normgraph.sources.tables import relational_graph
from normgraph.staging import scratch
from normgraph.streaming import watch


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return _t(spark, d, "documents").select("doc_id", "text")


def e_references(spark, d):
    return ex.references(_docs(spark, d)).select("doc_id", "kind", "target", "identifier", "start", "matched")


def e_reference_counts(spark, d):
    """References to instruments of the Union per document and kind."""
    found = ex.references(_docs(spark, d)).filter(F.col("target").isin("regulation", "directive", "decision"))
    return found.groupBy("doc_id", "target").agg(F.count(F.lit(1)).alias("n"))


def e_norm_counts(spark, d):
    hits = ex.scan_patterns(_docs(spark, d), [(f"{k}:{f}", p) for k, f, p in ex.NORMS], overlap=True)
    return hits.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def e_norms(spark, d):
    return ex.norms(_docs(spark, d))


def e_lines(spark, d):
    return ex.lines(_docs(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


def e_provisions(spark, d):
    return ex.provisions(_docs(spark, d)).groupBy("doc_id", "part", "chapter", "section", "article").agg(F.count(F.lit(1)).alias("n_lines"))


_TERMS = ("safeguard clause", "transfer mechanism", "appeal procedure", "draft text", "quorum", "retention period")


def e_term_usage(spark, d):
    terms = spark.createDataFrame([(t,) for t in _TERMS], "term string")
    return ex.term_usage(_docs(spark, d), terms)


_FORMATS = {
    "regulation": {"required": ((r"Article \d+", 2.0), (r"CHAPTER [IVX]+", 1.0)), "optional": ((r"Reg\. \(", 0.5),), "negative": ((r"Present:", 0.5),)},
    "rules": {"required": ((r"RULE [IVX]+", 2.0), (r"SEC\. \d+", 1.0)), "optional": ((r"Working Group", 0.25),), "negative": ((r"AGENDA", 0.5),)},
    "minutes": {"required": ((r"Present:", 2.0), (r"AGENDA", 1.0)), "optional": ((r"votes in favour", 0.5),), "negative": ((r"Article \d+", 0.25),)},
}


def e_formats(spark, d):
    return ex.format_scores(_docs(spark, d).filter("text is not null"), _FORMATS)


def e_search(spark, d):
    return ex.keyword_search(_docs(spark, d), ("safeguard", "levy"), ("permit", "waiver"))


def e_rules_diff(spark, d):
    """Clause changes with the similarity of their texts and how large the change is."""
    c = _t(spark, d, "clause_changes").filter("base_text <> '' and target_text <> ''").dropDuplicates(["change_id"])
    s = fn.word_similarity(F.col("base_text"), F.col("target_text"))
    return c.select("change_id", s.alias("similarity"), fn.change_label(s, F.col("base_text"), F.col("target_text")).alias("label"))


def e_line_diff(spark, d):
    c = _t(spark, d, "clause_changes").dropDuplicates(["change_id"]).select("change_id", F.regexp_replace("base_text", r"\. ", ".\n").alias("a"), F.regexp_replace("target_text", r"\. ", ".\n").alias("b"))
    return ex.text_diffs(c, "change_id", "a", "b").groupBy("change_id", "op").agg(F.count(F.lit(1)).alias("n"))


def e_triples(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text", F.concat(F.lit("doc:"), "doc_id").alias("base"))
    return ex.provision_triples(docs, F.col("base"))


def f_names(spark, d):
    """Normal forms of meeting chairs, roles and series."""
    m = _t(spark, d, "meetings").select("chair_name", "series").distinct()
    return m.select("chair_name", "series", fn.plain_name(F.col("chair_name")).alias("name"), fn.slug(F.col("series")).alias("slug"), fn.role_key(F.col("series")).alias("role"))


def f_roman(spark, d):
    c = _t(spark, d, "clause_changes").select("rule_no").distinct()
    return c.select("rule_no", fn.roman_value(F.col("rule_no")).alias("value"))


def x_ntriples(spark, d):
    return rdf.ntriples(relational_graph(spark, d, ("region", "nation", "customer")).triples)


def x_turtle(spark, d):
    return rdf.turtle(relational_graph(spark, d, ("region", "nation", "supplier")).triples)


def x_jsonld(spark, d):
    return rdf.jsonld(relational_graph(spark, d, ("region", "nation", "supplier")).triples)


def x_rdfxml(spark, d):
    return rdf.rdfxml(relational_graph(spark, d, ("region", "nation")).triples)


def x_dot(spark, d):
    _, edges = relational_graph(spark, d, ("nation", "supplier")).nodes_and_edges(("t:nation", "t:region"))
    return rdf.dot(edges)


def _stream(spark, d):
    schema = _t(spark, d, "events").schema
    return watch.watch_table(spark, d, schema, glob="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def w_windowed(spark, d):
    """Events counted per hour and type through a stream of files."""
    where = scratch(spark, "windows")
    out = watch.run_updates(watch.windowed_counts(_stream(spark, d)), f"{where}/out", f"{where}/state", ["start", "event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def w_first_seen(spark, d):
    """Users by a stream that lets each pass once, written to files."""
    name = scratch(spark, "seen")
    watch.run_once(watch.first_seen(_stream(spark, d).select("user_id", "ts"), "user_id", "ts", "60 days"), f"{name}/out", f"{name}/state")
    return spark.read.parquet(f"{name}/out").select("user_id")


QUERIES = {f.__name__: f for f in (e_references, e_reference_counts, e_norm_counts, e_norms, e_lines, e_provisions, e_term_usage, e_formats, e_search, e_rules_diff, e_line_diff, e_triples, f_names, f_roman, x_ntriples, x_turtle, x_jsonld, x_rdfxml, x_dot, w_windowed, w_first_seen)}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _formats_sql() -> str:
    out = []
    for name, f in _FORMATS.items():
        part = lambda k: " + ".join(["0.0", *(f"case when regexp_matches(text, {_q(p)}) then {w} else 0.0 end" for p, w in f[k])])
        need = sum(w for _, w in f["required"])
        out.append(f"select doc_id, {_q(name)} as format, cast(case when {part('required')} > 0 then greatest(0.0, least(1.0, ({part('required')} + {part('optional')} - ({part('negative')})) / {need})) else 0.0 end as double) as score from documents where text is not null")
    return " union all ".join(out)


_WORDS = "list_filter(string_split_regex(lower(trim({c})), '\\s+'), lambda w: w <> '')"
_SIM = "with c as (select distinct change_id, base_text, target_text from clause_changes where base_text <> '' and target_text <> ''), w as (select change_id, base_text a, target_text b, list_distinct(" + _WORDS.format(c="base_text") + ") x, list_distinct(" + _WORDS.format(c="target_text") + ") y from c), s as (select change_id, a, b, cast(case when len(x) + len(y) = 0 then 100 else floor(len(list_intersect(x, y)) * 100.0 / (len(x) + len(y) - len(list_intersect(x, y)))) end as int) similarity from w) "


_NAMED = "select 'region:' || r_regionkey s, 'rdf:type' p, 't:Region' o, false lit from region union all select 'region:' || r_regionkey, 't:name', r_name, true from region union all select 'nation:' || n_nationkey, 'rdf:type', 't:Nation', false from nation union all select 'nation:' || n_nationkey, 't:name', n_name, true from nation union all select 'nation:' || n_nationkey, 't:region', 'region:' || n_regionkey, false from nation"
_SUPPLIERS = " union all select 'supplier:' || s_suppkey, 'rdf:type', 't:Supplier', false from supplier union all select 'supplier:' || s_suppkey, 't:name', s_name, true from supplier union all select 'supplier:' || s_suppkey, 't:nation', 'nation:' || s_nationkey, false from supplier union all select 'supplier:' || s_suppkey, 't:balance', cast(s_acctbal as varchar), true from supplier"

SQL = {
    "x_turtle": f"with t as ({_NAMED}{_SUPPLIERS}) select s, s || chr(10) || string_agg('    ' || case when p = 'rdf:type' then 'a' else p end || ' ' || case when lit then '\"' || o || '\"' else o end, ' ;' || chr(10) order by p <> 'rdf:type', p) || ' .' || chr(10) as block from t group by s",
    "x_jsonld": f"with t as ({_NAMED}{_SUPPLIERS}) select s, '{{\"@id\":\"' || s || '\",' || string_agg('\"' || case when p = 'rdf:type' then '@type' else p end || '\":\"' || o || '\"', ',' order by p <> 'rdf:type', p) || '}}' as json from t group by s",
    "x_rdfxml": f"with t as ({_NAMED}) select s, '  <rdf:Description rdf:about=\"' || s || '\">' || chr(10) || string_agg('    <' || p || '>' || o || '</' || p || '>', chr(10) order by p <> 'rdf:type', p) || chr(10) || '  </rdf:Description>' as block from t group by s",
    "e_reference_counts": r"select doc_id, target, cast(sum(k) as bigint) as n from (select doc_id, 'regulation' as target, len(regexp_extract_all(text, '\b(Regulation|Reg\.)\s+\([A-Z]{2}\)\s+(No\.?\s+)?\d+/\d+')) k from documents union all select doc_id, 'directive', len(regexp_extract_all(text, '\bDirective\s+(\([A-Z]{2}\)\s+)?(No\.?\s+)?\d+/\d+')) from documents union all select doc_id, 'decision', len(regexp_extract_all(text, '\bDecision\s+(\([A-Z]{2}\)\s+)?(No\.?\s+)?\d+/\d+')) from documents) where k > 0 group by 1, 2",
    "e_norm_counts": r"""select rule, cast(sum(k) as bigint) as n, count(*) as n_docs from (
select 'prohibition:not' as rule, len(regexp_extract_all(text, '(?i)\b(shall|must|may)\s+not\s+\w+')) k from documents union all
select 'right:right_to', len(regexp_extract_all(text, '(?i)\b(has|have)\s+the\s+right\s+to\s+\w+')) from documents union all
select 'right:entitled', len(regexp_extract_all(text, '(?i)\b(is|are)\s+entitled\s+to\s+\w+')) from documents union all
select 'right:may', len(regexp_extract_all(text, '(?i)\bmay\s+\w+')) from documents union all
select 'obligation:required', len(regexp_extract_all(text, '(?i)\b(is|are)\s+required\s+to\s+\w+')) from documents union all
select 'obligation:shall', len(regexp_extract_all(text, '(?i)\b(shall|must)\s+\w+')) from documents) where k > 0 group by 1""",
    "e_lines": r"select doc_id, count(*) as n_lines from (select doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) l from documents) where trim(l) <> '' group by 1",
    "e_provisions": r"""with l as (select doc_id, unnest(range(len(x))) n, unnest(x) line from (select doc_id, string_split_regex(text, '\r\n|\r|\n') x from documents where text is not null)),
t as (select doc_id, n, trim(line) line from l where trim(line) <> ''),
h as (select *, regexp_extract(line, '^\s*(?:PART|TITLE|Title|TITRE|TÍTULO)\s+([IVXLC]+|\d+)\b', 1) p, regexp_extract(line, '^\s*(?:CHAPTER|Chapter|RULE|KAPITEL|CHAPITRE)\s+([IVXLC]+|\d+\w*)\b', 1) c, regexp_extract(line, '^\s*(?:Section|SECTION|SEC\.|§)\s+(\d+(?:[.-]\d+)*\w?)', 1) s, regexp_extract(line, '^\s*(?:Article|ARTICLE|Artikel|Artículo)\s+(\d+)\s*$', 1) a from t),
r as (select *, case when p <> '' then 0 when c <> '' then 1 when s <> '' then 2 when a <> '' then 3 end k from h),
w as (select *, arg_max(p, n) filter (where k = 0) over u p_, max(n) filter (where k < 1) over u b1, max(n) filter (where k < 2) over u b2, max(n) filter (where k < 3) over u b3, arg_max(c, n) filter (where k = 1) over u c_, max(n) filter (where k = 1) over u cn, arg_max(s, n) filter (where k = 2) over u s_, max(n) filter (where k = 2) over u sn, arg_max(a, n) filter (where k = 3) over u a_, max(n) filter (where k = 3) over u an from r window u as (partition by doc_id order by n rows unbounded preceding))
select doc_id, p_ as part, case when b1 is null or cn > b1 then c_ end as chapter, case when b2 is null or sn > b2 then s_ end as section, case when b3 is null or an > b3 then a_ end as article, count(*) as n_lines from w group by all""",
    "e_term_usage": r"with d as (select doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+'), '  ') || ' ' w from documents where text is not null), t as (select unnest(['safeguard clause', 'transfer mechanism', 'appeal procedure', 'draft text', 'quorum', 'retention period']) as term) select doc_id, term, len(regexp_extract_all(w, ' ' || replace(term, ' ', '  ') || 's? ')) as n from d, t where len(regexp_extract_all(w, ' ' || replace(term, ' ', '  ') || 's? ')) > 0",
    "f_roman": "with g as (select n, repeat('M', n // 1000) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] r from (select unnest(range(1, 4000)) n)) select rule_no, cast(n as int) as value from (select distinct rule_no from clause_changes) left join g on upper(trim(rule_no)) = r",
    "e_formats": _formats_sql(),
    "e_search": r"select doc_id, cast(10 * (len(regexp_extract_all(lower(text), '\bsafeguard\b')) + len(regexp_extract_all(lower(text), '\blevy\b'))) + 2 * (len(regexp_extract_all(lower(text), '\bpermit\b')) + len(regexp_extract_all(lower(text), '\bwaiver\b'))) as bigint) as score from documents where regexp_matches(lower(text), '\b(safeguard|levy|permit|waiver)\b')",
    "e_rules_diff": _SIM + "select change_id, similarity, case when similarity >= 80 then 'minor' when similarity >= 60 then 'moderate' when similarity >= 40 then 'substantial' when length(b) > 2 * length(a) then 'expanded' when length(a) > 2 * length(b) then 'condensed' else 'rewrite' end as label from s",
    "f_names": r"select chair_name, series, trim(regexp_replace(regexp_replace(regexp_replace(trim(chair_name), '(?i)^(mr|ms|mrs|dr|prof)\.?\s+', ''), '(?i)^the\s+', ''), '\s+', ' ', 'g')) as name, regexp_replace(regexp_replace(lower(trim(series)), '[\s-]+', '_', 'g'), '[^a-z0-9_]', '', 'g') as slug, regexp_replace(lower(trim(series)), '[-\s]', '', 'g') as role from (select distinct chair_name, series from meetings)",
    "x_ntriples": "with t as (select 'region:' || r_regionkey s, 'rdf:type' p, '<t:Region>' o from region union all select 'region:' || r_regionkey, 't:name', '\"' || r_name || '\"' from region union all select 'nation:' || n_nationkey, 'rdf:type', '<t:Nation>' from nation union all select 'nation:' || n_nationkey, 't:name', '\"' || n_name || '\"' from nation union all select 'nation:' || n_nationkey, 't:region', '<region:' || n_regionkey || '>' from nation union all select 'customer:' || c_custkey, 'rdf:type', '<t:Customer>' from customer union all select 'customer:' || c_custkey, 't:name', '\"' || c_name || '\"' from customer union all select 'customer:' || c_custkey, 't:nation', '<nation:' || c_nationkey || '>' from customer union all select 'customer:' || c_custkey, 't:segment', '\"' || c_mktsegment || '\"' from customer union all select 'customer:' || c_custkey, 't:balance', '\"' || c_acctbal || '\"' from customer) select '<' || s || '> <' || p || '> ' || o || ' .' as line from t",
    "x_dot": "select '  \"nation:' || n_nationkey || '\" -> \"region:' || n_regionkey || '\" [label=\"t:region\"];' as line from nation union all select '  \"supplier:' || s_suppkey || '\" -> \"nation:' || s_nationkey || '\" [label=\"t:nation\"];' from supplier",
    "w_windowed": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) as n from events group by 1, 2",
    "w_first_seen": "select distinct user_id from events",
}
