"""References and citations in legal texts, read by a small grammar.

A reference names a unit and its number, perhaps with subdivisions, a second
number and the larger units it stands in:

    reference  = unit numbers [within]
    unit       = a word of UNITS, or a section sign
    numbers    = number subdivision* [("and" | "to" | "through") number subdivision*]
    within     = "of" (reference | "this" unit | instrument | "the" name "Act")
    instrument = a kind of act, code or authority and its numbers

What the words of a unit are, how its numbers look and what its subdivisions are
called are tables; one parser reads all of them. Instruments are citations of
several jurisdictions and give the citation forms too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import regex

# Words of units, singular, plural and abbreviated.
UNITS = {
    "annex": ("annex", "annexes"),
    "article": ("article", "articles", "art."),
    "chapter": ("chapter", "chapters", "ch."),
    "clause": ("clause", "clauses"),
    "paragraph": ("paragraph", "paragraphs", "para.", "paras."),
    "part": ("part", "parts"),
    "point": ("point", "points"),
    "recital": ("recital", "recitals"),
    "rule": ("rule", "rules"),
    "section": ("section", "sections", "sec.", "secs.", "§", "§§"),
    "subchapter": ("subchapter", "subchapters"),
    "subdivision": ("subdivision", "subdivisions"),
    "subparagraph": ("subparagraph", "subparagraphs"),
    "subsection": ("subsection", "subsections"),
    "title": ("title", "titles"),
}
_PLURAL = frozenset(("annexes", "articles", "chapters", "clauses", "paragraphs", "paras.", "parts", "points", "recitals", "rules", "sections", "secs.", "§§", "subchapters", "subdivisions", "subparagraphs", "subsections", "titles"))
_ROMAN, _ARABIC, _MIXED, _BRACKET = r"[IVXLCDM]+\b", r"\d+", r"\d+(?:\.\d+)*[a-z]{0,3}(?:-\d+[a-z]?)*", r"\((?:[a-z]{1,2}|\d{1,3})\)"
#: How the numbers of units look; units that are not named have arabic or Roman ones.
NUMBERS = {
    "article": _ARABIC, "clause": _ARABIC, "recital": _ARABIC, "section": _MIXED, "rule": _ROMAN, "subchapter": rf"(?:{_ROMAN}|[ivx]+\b)",
    "point": _BRACKET, "subdivision": _BRACKET, "subparagraph": _BRACKET, "subsection": _BRACKET, "paragraph": rf"(?:{_ARABIC}|\(\d{{1,3}}\))",
}
#: What the brackets after a number stand for, outermost first.
SUBDIVISIONS = {
    "article": ("paragraph", "point", "subpoint"), "section": ("subsection", "paragraph", "subparagraph", "clause"), "subsection": ("paragraph", "subparagraph", "clause"),
    "clause": ("paragraph", "subparagraph", "item"), "paragraph": ("point", "subpoint"), "subdivision": ("paragraph", "subparagraph"), "subparagraph": ("clause",),
}


class Form(NamedTuple):
    """A form of citing an instrument: the groups of its pattern are its parts."""

    kind: str
    jurisdiction: str
    confidence: float
    pattern: str


def _letters(name: str) -> str:
    """A name of single letters, with or without points and blanks between them."""
    return r"\.?\s?".join(name) + r"\.?"


def _sign(*words: str) -> str:
    """An optional sign of a section or part before a number."""
    return r"(?:(?:" + "|".join(words) + r")\s*)?"


_PAIR, _SECTION = r"(\d+)/(\d+)", _sign("§+", "[Ss]ections?", "[Ss]ecs?\\.?")
_NAME = r"(?!(?:By|In|Of|See|The|Under)\b)[A-Z][\w'’-]*"
_ACT = rf"({_NAME}(?:\s+(?:[A-Z][\w'’-]*|\([A-Z][^)\n]*\)|of|and|the|for|in|on)){{0,9}}\s+Act)\b"
_LOCATORS = r"((?:,?\s*(?:vol(?:ume)?|ch(?:apter)?|sec(?:tion)?|§)\.?\s*\d+)*)"
#: Instruments and reports of cases. A form with a longer name of a kind comes before one with a shorter.
INSTRUMENTS = (
    Form("regulation", "eu", 1.0, rf"\b(?:Regulation|Reg\.)\s+\([A-Z]{{2}}\)\s+(?:No\.?\s+)?{_PAIR}"),
    Form("directive", "eu", 1.0, rf"\bDirective\s+(?:\([A-Z]{{2}}\)\s+)?(?:No\.?\s+)?{_PAIR}(?:/(?:EC|EU|EEC))?"),
    Form("decision", "eu", 0.95, rf"\b(?:Framework\s+)?Decision\s+(?:\([A-Z]{{2}}\)\s+)?(?:No\.?\s+)?{_PAIR}(?:/(?:EC|EU|EEC|JHA))?"),
    Form("treaty", "eu", 0.95, r"\b(?:Article|Art\.)\s+(\d+)(?:\(\d+\))?\s+(?:of\s+the\s+)?(TFEU|TEU|ECHR)\b"),
    Form("treaty", "eu", 0.9, r"\b(Treaty\s+on\s+(?:the\s+Functioning\s+of\s+the\s+)?European\s+Union|Treaty\s+on\s+the\s+Functioning\s+of\s+the\s+European\s+Union|TFEU|TEU)\b"),
    Form("case", "eu", 0.95, r"\bCase\s+([CTF])[‑-](\d+/\d+)"),
    Form("usc", "us", 1.0, rf"\b(\d+)\s+{_letters('USC')}A?\.?\s+{_SECTION}(\d+[a-z]*(?:-\d+[a-z]*)*)((?:\(\w{{1,3}}\))*)(\s+et\s+seq\.?)?"),
    Form("cfr", "us", 1.0, rf"\b(\d+)\s+{_letters('CFR')}\s+{_sign('§+', '[Pp]arts?')}(\d+(?:\.\d+)?)((?:\(\w{{1,3}}\))*)(\s+et\s+seq\.?)?"),
    Form("public_law", "us", 0.95, r"\b(?:Public\s+Law|Pub\.?\s*L\.?|P\.L\.)\s+(?:No\.?\s+)?(\d+)[-–](\d+)"),
    Form("statutes", "us", 0.9, r"\b(\d+)\s+Stat\.\s+(\d+)"),
    Form("federal_register", "us", 0.9, r"\b(\d+)\s+Fed\.\s?Reg\.\s+([\d,]+)"),
    Form("case", "us", 0.85, r"\b(\d+)\s+(?:U\.S\.|S\.\s?Ct\.|F\.(?:2d|3d|4th)?|F\.\s?Supp\.(?:\s?[23]d)?)\s+(\d+)"),
    Form("case", "uk", 0.95, r"\[(\d{4})\]\s+(UK(?:SC|HL|PC|UT|FTT)|EW(?:CA|HC|COP|FC)|CSIH|CSOH|NICA)(?:\s+(?:Civ|Crim))?\s+(\d+)(?:\s+\(\w+\))?"),
    Form("case", "uk", 0.85, r"[\[(](\d{4})[\])]\s+(?:\d+\s+)?(AC|QB|KB|Ch|WLR|All\s+ER|Fam|ICR|EHRR|CMLR)\s+(\d+)"),
    Form("si", "uk", 0.95, r"\b(?:S\.?I\.?|Statutory\s+Instruments?)\s+(?:No\.?\s+)?(\d{4})/(\d+)"),
    Form("act_chapter", "uk", 0.9, rf"\b{_ACT}\s+(\d{{4}})\s+\(?c(?:h(?:apter)?)?\.?\s*(\d+)\)?"),
    Form("act", "uk", 0.85, rf"\b{_ACT}\s+(\d{{4}})\b"),
    Form("named_act", "us", 0.7, rf"\bthe\s+{_ACT}(?!\s+\d)"),
    Form("jefferson", "house", 0.9, rf"\bJefferson['’]?s\s+Manual{_LOCATORS}"),
    Form("cannon", "house", 0.9, rf"(?:\b(\d+)\s+)?\bCannon(?:['’]?s\s+Precedents{_LOCATORS}|\s+(?:§|sec\.?)\s*(\d+))"),
    Form("deschler_brown", "house", 0.9, rf"\bDeschler-Brown\s+Precedents?{_LOCATORS}"),
    Form("deschler", "house", 0.9, rf"\bDeschler['’]?s\s+Precedents{_LOCATORS}"),
    Form("hinds", "house", 0.9, rf"(?:\b(\d+)\s+)?\bHinds['’]?\s+Precedents{_LOCATORS}"),
    Form("house_precedents", "house", 0.8, r"\bPrecedents\s+of\s+the\s+House\b"),
)


class Reference(NamedTuple):
    start: int
    end: int
    kind: str  # internal or external
    target: str  # the unit, in the plural for a range, or the kind of instrument
    numbers: tuple[str, ...]
    levels: dict[str, str]  # the number of every unit on the way to what is meant
    within: str  # the instrument it stands in, if another

    @property
    def identifier(self) -> str:
        return f"{self.target}:{'/'.join(self.numbers)}" if self.numbers else self.target


class _Unit(NamedTuple):
    unit: str
    plural: bool
    number: str
    subs: tuple[str, ...]
    last: str
    end: int


_WORDS = {w: unit for unit, words in UNITS.items() for w in words}
_BLANK = regex.compile(r"\s*")
_WORD = re.compile(r"(?<![\w-])(?:§§?|[A-Za-z]{2,12}\.?)(?=\s*[\dIVXLCDMivx(])")  # a word before what may be a number
_NUMBER = {u: regex.compile(NUMBERS.get(u, rf"(?:{_ROMAN}|{_ARABIC})")) for u in UNITS}
_SUB = regex.compile(r"\(([A-Za-z]{1,4}|\d{1,3})\)")
_JOIN = regex.compile(r"\s+(?:and|to|through)\s+")
_OF = regex.compile(r",?\s+of\s+")
_THIS = regex.compile(r"this\s+(?:" + "|".join(sorted(UNITS)) + r"|Act|Regulation|Directive|Decision)\b")
_FORMS = [(f, regex.compile(f.pattern)) for f in INSTRUMENTS]


def instrument_at(text: str, at: int) -> tuple[Form, regex.Match] | None:
    """The instrument that begins at a place of the text."""
    for form, pattern in _FORMS:
        if m := pattern.match(text, at):
            return form, m
    return None


def _unit(text: str, at: int) -> _Unit | None:
    """The unit whose word begins at a place, with its numbers."""
    m = _WORD.match(text, at)
    if not m or (word := m.group().lower()) not in _WORDS or word[0].isalpha() and (not (m.group().islower() or m.group().istitle() or m.group().isupper()) or text[m.end() : m.end() + 1] not in " \t\r\n\xa0("):
        return None
    unit, number = _WORDS[word], _NUMBER[_WORDS[word]]
    first = number.match(text, _BLANK.match(text, m.end()).end())
    if not first:
        return None
    value, subs, end = _subdivided(text, first)
    last = ""
    if word in _PLURAL and (join := _JOIN.match(text, end)) and (second := number.match(text, join.end())):
        last, _, end = _subdivided(text, second)
    return _Unit(unit, bool(last), value, subs, last, end)


def _subdivided(text: str, number: regex.Match) -> tuple[str, tuple[str, ...], int]:
    """A number without its brackets, the subdivisions after it, and where they end."""
    subs, end = [], number.end()
    while s := _SUB.match(text, end):
        subs.append(s.group(1))
        end = s.end()
    return number.group().strip("()"), tuple(subs), end


def reference_at(text: str, at: int) -> Reference | None:
    """The reference to a unit whose word begins at a place, with all it stands within."""
    inner = _unit(text, at)
    if not inner:
        return None
    levels: dict[str, str] = {}
    numbers: list[str] = []
    kind, within, unit = "internal", "", inner
    while True:
        for name, value in zip((unit.unit, *SUBDIVISIONS.get(unit.unit, ())), (unit.number, *unit.subs)):
            levels.setdefault(name, value)
        end = unit.end
        numbers += [unit.number, *((unit.last,) if unit.last else unit.subs)]
        of = _OF.match(text, end)
        if not of:
            break
        if this := _THIS.match(text, of.end()):
            end = this.end()
            break
        if outer := instrument_at(text, of.end()):
            kind, within, end = "external", outer[0].kind, outer[1].end()
            numbers += [g.strip() for g in outer[1].groups() if g]
            break
        wider = _unit(text, of.end())
        if not wider or wider.plural or wider.unit in levels:
            break
        if wider.unit == "title":  # of a code that is not this one
            kind = "external"
        unit = wider
    return Reference(at, end, kind, inner.unit + ("s" if inner.plural else ""), tuple(numbers), levels, within)


def references_in(text: str) -> Iterator[Reference]:
    """References and instruments of a text from left to right, none within another."""
    named: dict[int, tuple[Form, regex.Match]] = {}
    for form, m in citations_in(text):
        if form.kind != "named_act" and (m.start() not in named or m.end() > named[m.start()][1].end()):
            named[m.start()] = form, m
    at = 0
    for start in sorted({m.start() for m in _WORD.finditer(text) if m.group().lower() in _WORDS} | named.keys()):
        if start < at:
            continue
        found = reference_at(text, start)
        if start in named and (not found or named[start][1].end() > found.end):
            form, m = named[start]
            found = Reference(start, m.end(), "external", form.kind, tuple(g.strip() for g in m.groups() if g and g.strip()), {}, "")
        if found:
            yield found
            at = found.end


def citations_in(text: str, jurisdiction: str | None = None) -> Iterator[tuple[Form, regex.Match]]:
    """All citations of instruments and cases in a text, overlapping ones too."""
    for form, pattern in _FORMS:
        if jurisdiction in (None, form.jurisdiction):
            for m in pattern.finditer(text):
                yield form, m


#: Qualifiers of time: their words in order, alternatives separated by a stroke, and what may follow: a date, what did it, or nothing.
TIMES = (
    ("in_force_on", "in force on|from", "date"),
    ("stood_on", "as it stood on", "date"),
    ("amended", "as amended", "by?"),
    ("repealed", "repealed by", "by"),
    ("repealed", "repealed with effect from", "date"),
    ("enters_into_force", "enter|enters|entered into force", "date?"),
    ("original", "as originally enacted", ""),
    ("consolidated", "consolidated version", ""),
)
_DATE, _DOER = r"(\d{1,2}\s+\w+\s+\d{4})", r"([^.,;]+)"


def time_patterns() -> list[tuple[str, str]]:
    """(kind, pattern) of each qualifier of time."""
    out = []
    for kind, words, follows in TIMES:
        phrase = r"\s+".join(f"(?:{w})" if "|" in w else w for w in words.split())
        tail = {"date": rf"\s+{_DATE}", "date?": rf"(?:\s+on\s+{_DATE})?", "by": rf"\s+{_DOER}", "by?": rf"(?:\s+by\s+{_DOER})?", "": ""}[follows]
        out.append((kind, rf"(?i)\b{phrase}\b{tail}"))
    return out
