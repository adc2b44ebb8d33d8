"""Named queries over provision graphs, with parameters where they have any."""

from __future__ import annotations


def _rows(kind: str, *more: str, order: str = "?x", limit: int | None = None, extra: str = "") -> str:
    """A listing of resources of a kind with the values of some predicates."""
    shown = " ".join(f"?{m.split(':')[1]}" for m in more)
    parts = " ; ".join([f"a {kind}", *(f"{m} ?{m.split(':')[1]}" for m in more)])
    return f"SELECT ?x {shown} WHERE {{ ?x {parts} {extra} }} ORDER BY {order}" + (f" LIMIT {limit}" if limit else "")


def _ranked(kind: str, through: str, counted: str, inverse: bool = True, limit: int | None = None) -> str:
    """Resources of a kind ranked by how many of another they are linked with."""
    link = f"?y {through} ?x" if inverse else f"?x {through} ?y"
    typed = f"?y a {counted} ." if counted else ""
    return f"SELECT ?x ?title (COUNT(?y) AS ?n) WHERE {{ ?x a {kind} ; reg:title ?title . {link} . {typed} }} GROUP BY ?x ?title ORDER BY DESC(?n)" + (f" LIMIT {limit}" if limit else "")


TEMPLATES: dict[str, str] = {
    "articles": _rows("reg:Article", "reg:title"),
    "chapters": _rows("reg:Chapter", "reg:title"),
    "definitions": _rows("reg:DefinedTerm", "reg:term", "reg:definition", order="?term"),
    "recitals": _rows("reg:Recital", "reg:number", order="?number", limit=20),
    "references": "SELECT ?from ?to WHERE { ?from reg:references ?to } ORDER BY ?from LIMIT 50",
    "rights": "SELECT ?x ?title ?right ?type WHERE { ?x a reg:Article ; reg:title ?title ; reg:grantsRight ?right . ?right reg:rightType ?type } ORDER BY ?x",
    "obligations": "SELECT ?x ?title ?duty ?type WHERE { ?x a reg:Article ; reg:title ?title ; reg:imposesObligation ?duty . ?duty reg:obligationType ?type } ORDER BY ?x",
    "right-types": "SELECT DISTINCT ?type WHERE { ?x a reg:Right ; reg:rightType ?type }",
    "obligation-types": "SELECT DISTINCT ?type WHERE { ?x a reg:Obligation ; reg:obligationType ?type }",
    "article-refs": 'SELECT ?x ?title WHERE { ?x reg:references ?to ; reg:title ?title . FILTER(CONTAINS(?to, "{article}")) }',
    "search": 'SELECT ?x ?title WHERE { ?x a reg:Article ; reg:title ?title . FILTER(CONTAINS(?title, "{word}")) }',
    "term-usage": "SELECT ?x ?term WHERE { ?x reg:usesTerm ?t . ?t reg:term ?term } ORDER BY ?term LIMIT 50",
    "term-articles": 'SELECT ?x ?title WHERE { ?x reg:usesTerm ?t ; reg:title ?title . ?t reg:normalizedTerm "{term}" } ORDER BY ?x',
    "article-terms": 'SELECT ?term WHERE { ?x reg:usesTerm ?t . ?t reg:term ?term . FILTER(CONTAINS(?x, "{article}")) }',
    "hierarchy": "SELECT ?chapter ?chapter_title ?x ?title WHERE { ?chapter a reg:Chapter ; reg:title ?chapter_title ; reg:contains ?x . ?x a reg:Article ; reg:title ?title } ORDER BY ?chapter ?x LIMIT 30",
    "most-referenced": "SELECT ?to (COUNT(?from) AS ?n) WHERE { ?from reg:references ?to } GROUP BY ?to ORDER BY DESC(?n) ?to",
    "definition-links": "SELECT ?term ?x WHERE { ?t a reg:DefinedTerm ; reg:term ?term ; reg:definedIn ?x } ORDER BY ?term",
    "bidirectional": "SELECT ?from ?to WHERE { ?from reg:references ?to . ?to reg:referencedBy ?from } LIMIT 20",
    "describe-article": "DESCRIBE {article}",
    "top-chapters-by-sections": _ranked("reg:Chapter", "reg:hasSection", "reg:Section", inverse=False, limit=20),
    "sections-with-obligations": "SELECT ?x ?title ?duty ?type WHERE { ?x a reg:Section ; reg:title ?title ; reg:contains ?a . ?a reg:imposesObligation ?duty . ?duty reg:obligationType ?type } ORDER BY ?x",
    "definition-coverage": _ranked("reg:Regulation", "reg:belongsTo", "reg:DefinedTerm"),
    "cross-ref-density": _ranked("reg:Article", "reg:references", "", inverse=False, limit=30),
    "rights-enumeration": "SELECT ?right ?type ?x ?title WHERE { ?right a reg:Right ; reg:rightType ?type ; reg:partOf ?x . ?x reg:title ?title } ORDER BY ?type ?x",
    "title-size-comparison": _ranked("reg:Regulation", "reg:belongsTo", "reg:Article"),
    "orphan-sections": "SELECT ?x ?title WHERE { ?x a reg:Section ; reg:title ?title . OPTIONAL { ?x reg:contains ?a . ?a reg:references ?to } FILTER(!BOUND(?to)) } ORDER BY ?x",
    "definition-reuse": "SELECT ?term (COUNT(DISTINCT ?r) AS ?n) WHERE { ?t a reg:DefinedTerm ; reg:normalizedTerm ?term ; reg:belongsTo ?r } GROUP BY ?term HAVING(COUNT(DISTINCT ?r) > 1) ORDER BY DESC(?n)",
    "chapter-structure": "SELECT ?r ?r_title ?chapter ?chapter_title ?x ?title WHERE { ?r a reg:Regulation ; reg:title ?r_title ; reg:hasChapter ?chapter . ?chapter a reg:Chapter ; reg:title ?chapter_title . OPTIONAL { ?chapter reg:hasSection ?x . ?x a reg:Section ; reg:title ?title } } ORDER BY ?r ?chapter ?x",
    "temporal-analysis": "SELECT ?ref ?kind ?detail ?x ?title WHERE { ?ref a reg:Reference ; reg:temporalKind ?kind ; reg:partOf ?x . ?x reg:title ?title . OPTIONAL { ?ref reg:temporalDescription ?detail } } ORDER BY ?kind ?x",
}

DEFAULTS = {"article": "GDPR:Art17", "word": "erasure", "term": "personal data"}


def render(name: str, **values: str) -> str:
    """A template's query with its parameters filled in; a quote in a value is refused."""
    text = TEMPLATES[name]
    for k, v in {**DEFAULTS, **values}.items():
        if '"' in v or "{" in v:
            raise ValueError(f"{k} may not hold quotes or braces")
        text = text.replace("{" + k + "}", v)
    return text
