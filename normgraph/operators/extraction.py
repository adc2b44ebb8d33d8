"""Text to rows: structure, definitions, references, rights and duties, term usage, formats, search.

Structure, usage, formats and search are plain column expressions. What needs
places in the text runs through :func:`scan_patterns`, one pass of one combined
expression over Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normgraph.operators.grammar import references_in, time_patterns

# Phrases that grant rights or impose duties, the more specific before the more general.
NORMS = (
    ("prohibition", "not", r"(?i)\b(?:shall|must|may)\s+not\s+(\w+)"),
    ("right", "right_to", r"(?i)\b(?:has|have)\s+the\s+right\s+to\s+(\w+)"),
    ("right", "entitled", r"(?i)\b(?:is|are)\s+entitled\s+to\s+(\w+)"),
    ("right", "may", r"(?i)\bmay\s+(\w+)"),
    ("obligation", "required", r"(?i)\b(?:is|are)\s+required\s+to\s+(\w+)"),
    ("obligation", "shall", r"(?i)\b(?:shall|must)\s+(\w+)"),
)
# Forms of definitions.
DEFINITIONS = (
    ("numbered", r"(?m)^\s*\((\d+)\)\s+['‘’\"“”]([^'‘’\"“”]+)['‘’\"“”][^\n]*?\bmeans\b:?\s*([^\n]*)"),
    ("lettered", r"(?m)^\s*\(([a-z])\)\s+['‘’\"“”]([^'‘’\"“”]+)['‘’\"“”]\s+means\b:?\s*([^\n]*)"),
    ("term", r"[Tt]he\s+term\s+['‘’\"“”]([^'‘’\"“”]+)['‘’\"“”]\s+(?:means|includes)\s*([^\n.;]*)"),
)
# Amendment phrases of draft bills.
AMENDMENTS = (
    ("strike_insert", r"(?is)\b(?:by\s+)?striking\s+[\"“]([^\"”]*)[\"”]\s+and\s+inserting\s+[\"“]([^\"”]*)[\"”]"),
    ("strike", r"(?is)\bby\s+striking\s+[\"“]([^\"”]*)[\"”]"),
    ("add", r"(?i)\bby\s+(?:adding|inserting)\s+(?:at\s+the\s+end|after\s+\S+\s+\S+)"),
    ("redesignate", r"(?i)\bby\s+redesignating\s+(\w+\s+\S+)\s+as\s+(\w+\s+\S+)"),
    ("repeal", r"(?i)\b(?:is|are)\s+(?:hereby\s+)?repealed\b"),
    ("replace", r"(?i)\bis\s+amended\s+to\s+read\s+as\s+follows"),
)
# Headings by line, outermost level first.
HEADINGS = (("part", r"^\s*(?:PART|TITLE|Title|TITRE|TÍTULO)\s+([IVXLC]+|\d+)\b"), ("chapter", r"^\s*(?:CHAPTER|Chapter|RULE|KAPITEL|CHAPITRE)\s+([IVXLC]+|\d+\w*)\b"), ("section", r"^\s*(?:Section|SECTION|SEC\.|§)\s+(\d+(?:[.-]\d+)*\w?)"), ("article", r"^\s*(?:Article|ARTICLE|Artikel|Artículo)\s+(\d+)\s*$"))


def _scan(key: str, rules: Sequence[tuple[str, str]], overlap: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [n for n, _ in rules]
        each = [regex.compile(p, regex.ASCII) for _, p in rules]
        for batch in batches:
            doc, rule, start, end, text_out, groups = [], [], [], [], [], []
            for row, text in enumerate(batch["text"].to_pylist()):
                if not text:
                    continue
                hits = [(m.start(), k, m) for k, r in enumerate(each) for m in r.finditer(text)]
                hits.sort(key=lambda h: (h[0], h[1]))
                last = 0
                for at, k, m in hits:
                    if not overlap and at < last:
                        continue
                    last = max(last, m.end())
                    doc.append(row)
                    rule.append(names[k])
                    start.append(at)
                    end.append(m.end())
                    text_out.append(m.group())
                    groups.append(list(m.groups()))
            yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(doc, pa.int64())), pa.array(rule, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(text_out, pa.string()), pa.array(groups, pa.list_(pa.string()))], names=[key, "rule", "start", "end", "matched", "groups"])

    return run


def scan_patterns(documents: DataFrame, rules: Sequence[tuple[str, str]], key: str = "doc_id", text: str = "text", overlap: bool = False) -> DataFrame:
    """(key, rule, start, end, matched, groups) of every match of named patterns in each text, in code points.

    Without ``overlap`` a match that begins within an earlier one is left out;
    of matches that begin at one place the first rule's holds. Classes such as
    \\s and \\w are those of ASCII. Null and empty texts match nothing. Only the two columns are read.
    """
    rows = documents.select(documents[key].alias(key), documents[text].alias("text"))
    return rows.mapInArrow(_scan(key, list(rules), overlap), f"`{key}` {rows.schema[0].dataType.simpleString()}, rule string, start long, end long, matched string, groups array<string>")


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found = [], []
        for row, text in enumerate(batch["text"].to_pylist()):
            mine = list(references_in(text)) if text else []
            rows += [row] * len(mine)
            found += [(r, text[r.start : r.end]) for r in mine]
        out = {
            "kind": pa.array([r.kind for r, _ in found], pa.string()), "target": pa.array([r.target for r, _ in found], pa.string()), "identifier": pa.array([r.identifier for r, _ in found], pa.string()),
            "start": pa.array([r.start for r, _ in found], pa.int64()), "end": pa.array([r.end for r, _ in found], pa.int64()), "matched": pa.array([m for _, m in found], pa.string()),
            "levels": pa.array([list(r.levels.items()) for r, _ in found], pa.map_(pa.string(), pa.string())), "within": pa.array([r.within or None for r, _ in found], pa.string()),
        }
        yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(rows, pa.int64())), *out.values()], names=["key", *out])


def references(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, target, identifier, start, end, matched, levels, within): references to provisions and instruments.

    kind: internal or external; target: the unit, in the plural for a range, or the kind of instrument; identifier:
    target and numbers; levels: the number of each unit on the way ('article': '6', 'paragraph': '1'); within:
    the instrument a unit belongs to, if it is another. None begins within an earlier one. Null and empty texts have none.
    """
    rows = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    found = rows.mapInArrow(_references, f"key {kind}, kind string, target string, identifier string, start long, end long, matched string, levels map<string,string>, within string")
    return found.withColumnRenamed("key", key)


def temporal_qualifiers(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, date, detail, start, matched)."""
    hits = scan_patterns(documents, time_patterns(), key, text)
    detail = F.array_join(F.array_compact("groups"), " ")
    return hits.select(key, F.col("rule").alias("kind"), F.try_to_date(detail, "d MMMM yyyy").alias("date"), detail.alias("detail"), "start", "matched")


def norms(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, form, verb, start, matched): rights, obligations and prohibitions."""
    hits = scan_patterns(documents, [(f"{kind}:{form}", p) for kind, form, p in NORMS], key, text)
    return hits.select(key, F.split_part("rule", F.lit(":"), F.lit(1)).alias("kind"), F.split_part("rule", F.lit(":"), F.lit(2)).alias("form"), F.lower(F.get("groups", F.lit(0))).alias("verb"), "start", "matched")


def definitions(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, number, term, normalized, definition, start)."""
    hits = scan_patterns(documents, DEFINITIONS, key, text)
    n = F.size("groups")
    at = lambda k: F.get("groups", n - k)
    return hits.select(key, F.when(n > 2, F.get("groups", F.lit(0))).alias("number"), F.trim(at(2)).alias("term"), F.lower(F.trim(at(2))).alias("normalized"), F.trim(at(1)).alias("definition"), "start")


def amendments(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, old, new, start, matched) of a draft bill's amendment phrases."""
    hits = scan_patterns(documents, AMENDMENTS, key, text)
    return hits.select(key, F.col("rule").alias("kind"), F.get("groups", F.lit(0)).alias("old"), F.get("groups", F.lit(1)).alias("new"), "start", "matched")


def lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line) of each text, trimmed; blank lines are left out."""
    each = documents.select(documents[key].alias(key), F.posexplode(F.split(documents[text], r"\r\n|\r|\n")).alias("line_no", "line"))
    return each.select(key, "line_no", F.trim("line").alias("line")).filter("line <> ''")


def provisions(documents: DataFrame, key: str = "doc_id", text: str = "text", headings: Sequence[tuple[str, str]] = HEADINGS) -> DataFrame:
    """(key, line_no, line, level, and one column per level): every line with the headings it stands under.

    A heading ends those below its level. Lines before any heading have nulls; a document without text has no rows.
    """
    rows = lines(documents, key, text)
    level = F.coalesce(*[F.when(F.col("line").rlike(p), F.lit(k)) for k, (_, p) in enumerate(headings)])
    rows = rows.withColumn("rank", level)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    out = rows
    for k, (name, p) in enumerate(headings):
        here = F.when(F.col("rank") == k, F.struct("line_no", F.regexp_extract("line", p, 1).alias("n")))
        broken = F.max(F.when(F.col("rank") < k, F.col("line_no"))).over(w)
        last = F.last(here, ignorenulls=True).over(w)
        out = out.withColumn(name, F.when(broken.isNull() | (last["line_no"] > broken), last["n"]))
    names = F.create_map(*[F.lit(x) for k, (n, _) in enumerate(headings) for x in (k, n)])
    return out.select(key, "line_no", "line", names[F.col("rank")].alias("level"), *[n for n, _ in headings])


def term_usage(documents: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, n): how often each term, or its plural in s, occurs in each text.

    A place of a text is looked at if its word is the first of a term: an equi-join on that word. What follows is
    compared with the whole term, of any number of words. No text is tested against every term.
    """
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))
    t = terms.select(split(F.col("term")).alias("words")).filter(F.size("words") > 0).distinct()
    t = t.select(F.array_join("words", " ").alias("term"), F.size("words").alias("n_words"), F.explode(F.array("words", F.concat(F.slice("words", 1, F.size("words") - 1), F.array(F.concat(F.element_at("words", -1), F.lit("s")))))).alias("form"))
    t = t.withColumn("first", F.get("form", F.lit(0)))
    docs = documents.select(documents[key].alias(key), split(documents[text]).alias("w"))
    lengths = [r["n_words"] for r in t.select("n_words").distinct().collect()]  # a few small numbers
    if not lengths:
        return docs.select(key, F.lit("").alias("term"), F.lit(0).cast("long").alias("n")).limit(0)
    # words of every place as long as the longest term; of many places with no first word of a term nothing is kept
    places = docs.select(key, F.explode(F.transform("w", lambda x, i: F.struct(x.alias("first"), F.slice("w", i + 1, max(lengths)).alias("ahead")))).alias("p")).select(key, "p.*")
    fits = F.slice("ahead", 1, F.col("n_words")) == F.col("form")
    return places.join(t, "first").filter(fits).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def format_scores(documents: DataFrame, formats: Mapping[str, Mapping[str, Sequence[tuple[str, float]]]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, format, score): weights of the matched indicators over those of the required ones, within 0 and 1; 0 if no required one matches."""
    c = documents[text]
    scores = []
    for name, f in formats.items():
        sum_of = lambda part: sum((F.when(c.rlike(p), F.lit(float(w))).otherwise(0.0) for p, w in f.get(part, ())), F.lit(0.0))
        need = sum(w for _, w in f["required"]) or 1.0
        required = sum_of("required")
        raw = (required + sum_of("optional") - F.abs(sum_of("negative"))) / need
        scores.append(F.struct(F.lit(name).alias("format"), F.when(required > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(0.0).alias("score")))
    return documents.select(documents[key].alias(key), F.explode(F.array(*scores)).alias("f")).select(key, "f.format", "f.score")


def keyword_search(documents: DataFrame, primary: Sequence[str], related: Sequence[str] = (), key: str = "doc_id", text: str = "text", title: str | None = None) -> DataFrame:
    """(key, score) of texts that hold a keyword: 10 for each hit of a primary one, 2 of a related one, 20 if a primary one is in the title."""
    c = F.lower(documents[text])
    count = lambda w: F.coalesce(F.regexp_count(c, F.lit(r"\b\Q" + w.lower() + r"\E\b")), F.lit(0))
    score = sum((count(w) * 10 for w in primary), F.lit(0)) + sum((count(w) * 2 for w in related), F.lit(0))
    if title:
        score = score + sum((F.when(F.contains(F.lower(documents[title]), F.lit(w.lower())), 20).otherwise(0) for w in primary), F.lit(0))
    return documents.select(documents[key].alias(key), score.cast("bigint").alias("score")).filter("score > 0")


def line_diff(a: Sequence[str], b: Sequence[str]) -> list[tuple[str, str]]:
    """('=', '-' or '+', line) of two lists of lines by longest common subsequence; ties delete first."""
    n, m = len(a), len(b)
    length = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            length[i][j] = length[i + 1][j + 1] + 1 if a[i] == b[j] else max(length[i + 1][j], length[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append(("=", a[i]))
            i, j = i + 1, j + 1
        elif j == m or i < n and length[i + 1][j] >= length[i][j + 1]:
            out.append(("-", a[i]))
            i += 1
        else:
            out.append(("+", b[j]))
            j += 1
    return out


def text_diffs(pairs: DataFrame, key: str, base: str, target: str) -> DataFrame:
    """(key, position, op, line): line differences of each pair of texts; nulls count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, position, op, line = [], [], [], []
            for k, (x, y) in enumerate(zip(batch["a"].to_pylist(), batch["b"].to_pylist())):
                for at, (o, t) in enumerate(line_diff((x or "").splitlines(), (y or "").splitlines())):
                    rows.append(k)
                    position.append(at)
                    op.append(o)
                    line.append(t)
            yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(rows, pa.int64())), pa.array(position, pa.int32()), pa.array(op, pa.string()), pa.array(line, pa.string())], names=[key, "position", "op", "line"])

    rows = pairs.select(pairs[key].alias(key), pairs[base].alias("a"), pairs[target].alias("b"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, position int, op string, line string")


def provision_triples(documents: DataFrame, prefix: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(s, p, o) of documents: articles with number, title and chapter, their references, norms and defined terms.

    An article's title is the line after its heading. ``prefix`` is a column of the documents that starts its URIs.
    """
    docs = documents.select(documents[key].alias(key), documents[text].alias("text"), prefix.alias("base"))
    rows = provisions(docs, key).filter("article is not null")
    w = Window.partitionBy(key, "article").orderBy("line_no")
    art = rows.withColumn("n", F.row_number().over(w)).groupBy(key, "article").agg(F.min("chapter").alias("chapter"), F.min(F.when(F.col("n") == 2, F.col("line"))).alias("title"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"))
    art = art.join(docs.select(key, "base"), key).withColumn("s", F.concat("base", F.lit(":Art"), "article"))
    t = lambda p, o: F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"))
    base = art.select("s", F.explode(F.array(t("rdf:type", F.lit("reg:Article")), t("reg:number", F.col("article")), t("reg:title", F.col("title")), t("reg:partOf", F.concat("base", F.lit(":Chapter"), "chapter")))).alias("t")).select("s", "t.p", "t.o").filter("o is not null")
    body = art.select("s", "base", "body")
    refs = references(body, "s", "body").filter("target = 'article'").join(body.select("s", "base"), "s").select("s", F.lit("reg:references").alias("p"), F.concat("base", F.lit(":Art"), F.split_part(F.split_part("identifier", F.lit(":"), F.lit(2)), F.lit("/"), F.lit(1))).alias("o"))
    duties = norms(body, "s", "body").select("s", F.when(F.col("kind") == "right", "reg:grantsRight").otherwise("reg:imposesObligation").alias("p"), F.concat_ws(":", "s", "kind", "verb").alias("o"))
    terms = definitions(body, "s", "body").select("s", F.lit("reg:defines").alias("p"), F.col("normalized").alias("o"))
    return base.unionByName(refs).unionByName(duties).unionByName(terms).distinct()
