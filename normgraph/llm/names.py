"""Variant spellings of names typed by people.

Each spelling is read as a person, body or delegation with a core (family name
or place), a given name or subject, and its parts. MinHash bands over the padded
q-grams of its parts, in whatever order these stand, propose pairs; for what is
too short for the collision curve, or too frequent for bands, keys that every two
cores or parts within the accepted edits share propose the rest. A Monge–Elkan similarity over the parts verifies
pairs; star clustering turns links into entities.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import permutations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.llm.hashing import band_keys, bands_for, mix64
from normgraph.llm.near_duplicates import banded_pairs
from normgraph.staging import Staged, stage

# Forms of address and functions put before or after a name.
TITLES = frozenset("dr prof amb hon mr mrs ms sir dame lord lady rev fr sen rep gov min mme mlle herr frau sr sra delegate rapporteur chair chairman chairwoman chairperson secretary president observer the".split())
# Kinds of bodies and their usual abbreviations.
BODIES = {
    "agency": ("agcy", "ag"), "association": ("assn", "assoc", "ass"), "authority": ("auth",), "board": ("bd",), "bureau": ("bur",), "centre": ("ctr", "center"), "chamber": ("chbr", "chmbr"),
    "commission": ("comm", "commn"), "committee": ("cttee", "cmte", "ctte"), "council": ("cncl", "coun"), "department": ("dept", "dep"), "federation": ("fed", "fedn"), "institute": ("inst", "instit"),
    "ministry": ("min",), "office": ("off",), "union": ("un",), "society": ("soc",), "court": ("ct",), "foundation": ("fdn", "found"), "organisation": ("org", "organization"),
}
LINKING = frozenset("for f of on the and de du des la fur".split())
NOBILIARY = frozenset("von van de der den da di du del la le zu".split())
NO_NAMES = frozenset(("unknown", "n/a", "none", "anonymous"))
# Given names and their familiar forms, as general reference books on names list them.
FAMILIAR = {
    "abigail": "abby gail", "albert": "al bert bertie", "alexander": "alex sasha sandy xander lex alec", "alfred": "alf alfie", "andrew": "andy drew", "anastasia": "nastya", "anthony": "tony", "barbara": "barb babs",
    "bartholomew": "bart", "benjamin": "ben benny", "catherine": "cathy kate", "charles": "charlie chuck", "charlotte": "lotte lottie charlie", "christina": "tina chrissy", "christopher": "chris kit topher", "daniel": "dan danny",
    "david": "dave", "deborah": "deb debbie", "dmitri": "dima mitya", "donald": "don donnie", "dorothea": "dora dot thea dottie dorothy", "edward": "ed ned ted eddie teddy", "ekaterina": "katya", "eleanor": "ellie nora",
    "elisabeth": "betty liz elisa lisa beth lizzie lisbeth elizabeth", "emanuel": "manny", "eugene": "gene", "florence": "flo", "frances": "franny", "francisco": "paco pancho fran frank curro", "frederick": "fred freddy", "gabriel": "gabe",
    "gerald": "gerry", "giuseppe": "beppe peppe pino joe", "gregory": "greg", "harold": "hal", "heinrich": "heinz heiner", "helena": "lena", "henrietta": "hetty etta harriet hattie", "henry": "harry hank",
    "ignacio": "nacho iggy", "isabel": "bel isa izzy bella isabella", "ivan": "vanya", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny", "johannes": "hans jo johann hannes jan", "john": "jack johnny",
    "jonathan": "jon jonny", "jose": "pepe", "joseph": "joe joey", "judith": "judy", "jurgen": "jupp jorg", "katharina": "kate kathi katja kati kathy käthe katrin katherine", "kenneth": "ken kenny", "lawrence": "larry laurie lars",
    "leonard": "leo len lenny", "louis": "lou", "magdalena": "magda lena", "manuel": "manolo", "margaret": "maggie peggy meg greta marge", "maria": "mia", "matthew": "matt", "michael": "mike mick misha", "nathaniel": "nat nate",
    "nicholas": "nick", "nikolai": "kolya nik nick niko", "oleksandr": "oles sasha olek", "oliver": "ollie", "pamela": "pam", "patricia": "pat patty", "penelope": "penny nell poppy", "peter": "pete", "philip": "phil pip",
    "raymond": "ray", "rebecca": "becky", "richard": "dick rick rich", "robert": "bob rob bert bobby robbie", "ronald": "ron ronnie", "rosario": "charo", "samuel": "sam sammy", "sebastian": "seb bastian", "stephen": "steve",
    "susan": "sue suzy", "tatiana": "tanya", "theodora": "thea dora teddy theo", "therese": "resi tess terry theresa", "thomas": "tom tommy", "timothy": "tim", "ulrike": "ulli uli rike", "ursula": "uschi", "victoria": "vicky tori vic",
    "vincent": "vince", "vladimir": "vova", "walter": "walt wally", "wilhelm": "willi", "william": "bill will billy willy liam", "yevgenia": "zhenya jenya genia evgenia", "zoe": "zo zoey",
}

_SPECIAL = str.maketrans({"ø": "o", "å": "a", "æ": "ae", "ß": "ss", "ð": "d", "þ": "th", "ł": "l", "đ": "d", "œ": "oe", "ı": "i"})
_WORD = re.compile(r"[^\W_]+\.?")
_FREQUENT = 200  # spellings with a common word from which on it tells too little to look for
_Q = 3
_ROWS = 3
_BANDED = 0.5, 0.99  # Jaccard similarity of padded q-grams, and the recall of the bands there
_WHOLE = 24  # letters of a core up to which keys are of deletions, which grow with the square; beyond, of pieces


def fold(s: str) -> str:
    """Lower case without marks."""
    s = unicodedata.normalize("NFKC", s).lower().translate(_SPECIAL)
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def single_vowels(s: str) -> str:
    """ae, oe and ue as a, o and u, as some type vowels with marks: for cores only."""
    return re.sub("([aou])e", r"\1", s)


def distance(a: str, b: str, most: int = 3) -> int:
    """Edits between two strings, a swap of neighbours counting one; over ``most`` is ``most`` + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row[j] = d
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


_FORMAL: dict[str, frozenset[str]] = {}
for _g, _short in FAMILIAR.items():
    for _n in (_g, *_short.split()):
        _FORMAL[fold(_n)] = _FORMAL.get(fold(_n), frozenset()) | {fold(_g)}
_BODY = {fold(w): fold(k) for k, short in BODIES.items() for w in (k, *short)}


class Reading(NamedTuple):
    """What a spelling names. ``parts`` are a person's names in the order of the alphabet, without initials;
    ``sure`` tells whether the form or a known given name shows which of them is the family's."""

    kind: str
    core: str
    given: str  # of bodies, the kind of body
    subject: list[str]
    parts: list[str] = []
    sure: bool = True


class Reader:
    """Reads spellings, given the words that are common over all of them (subjects, given names)."""

    def __init__(self, common: dict[str, int]):
        strong = {w for w in common if not any(common[v] >= 4 * common[w] and distance(v, w, 1) <= 1 for v in common if abs(len(v) - len(w)) <= 1 and len(v) > 3 and v != w)}
        self.common = strong
        self.frequent = frozenset(w for w, n in common.items() if n >= _FREQUENT)
        self._common_given = frozenset(w for w in strong if w in _FORMAL)
        self._near: dict[tuple[str, int], str | None] = {}

    def _nearest(self, word: str, among, which: int, least: int = 4) -> str | None:
        """The word of ``among`` that is the same or one edit away; for longer words only."""
        if word in among:
            return word
        if len(word) < least:
            return None
        key = (word, which)
        if key not in self._near:
            if len(self._near) > 200_000:
                self._near.clear()
            self._near[key] = min((w for w in among if len(w) >= least and abs(len(w) - len(word)) <= 1 and distance(w, word, 1) <= 1), default=None)
        return self._near[key]

    def body_kind(self, word: str) -> str | None:
        near = self._nearest(word, _BODY, 0, 5)
        return _BODY[near] if near else None

    def _subject(self, word: str, dotted: bool) -> str:
        if dotted:
            full = sorted(w for w in self.common if w.startswith(word) and w not in _BODY)
            return full[0] if full else word
        return self._nearest(word, self.common, 1, 3) or word

    def read(self, name: str) -> Reading:
        """The reading of a spelling; kind '' if it names nobody."""
        text = unicodedata.normalize("NFKC", name).strip()
        plain = fold(text)
        if not plain.strip() or plain.strip() in NO_NAMES:
            return Reading("", "", "", [])
        raw = [(m.group().rstrip("."), m.group().endswith("."), m.start()) for m in _WORD.finditer(text)]
        words = [(fold(w), dot, w, at) for w, dot, at in raw]
        if not words:
            return Reading("other", re.sub(r"\s+", "", plain), "", [])
        for k, (w, dot, *_) in enumerate(words):
            if w in ("del", "deleg") and (dot or "(" in text) or len(w) > 7 and distance(w, "delegation", 1) <= 1:
                core = "".join(single_vowels(v) for j, (v, *_) in enumerate(words) if j != k and v not in LINKING)
                return Reading("delegation", core, "", [])
        kinds = [(k, kind) for k, (w, *_) in enumerate(words) if (kind := self.body_kind(w))]
        links = [k for k, (w, *_) in enumerate(words) if w in LINKING or distance(w, "for", 1) <= 1 and 2 <= len(w) <= 4]
        if kinds and (len(words) > 3 or links):
            return self._body(text, words, kinds, links)
        if len(words) == 2 and (last := words[1][2]).isupper() and 3 <= len(last) <= 5 and not words[0][2].isupper() and words[0][0] not in _FORMAL:
            return Reading("body", single_vowels(words[0][0]), "", ["~" + words[1][0]])
        return self._person(text, words)

    def _body(self, text, words, kinds, links):
        at, kind = kinds[0]
        rest = [k for k in range(len(words)) if k != at and k not in links]
        cut, comma = text.find("("), text.rfind(",")
        edge = max(cut, comma)
        if edge > 0:  # Kind for Subject (Place); Subject Kind, Place
            place = [k for k in rest if words[k][3] > edge]
        elif of := [k for k in links if words[k][0] == "of" and k > at + 1]:  # Kind for Subject of Place
            place = [k for k in rest if k > of[-1]]
        else:  # Place Kind for Subject
            place = [k for k in rest if k < at]
        if not place:
            place = rest[:1]
        subject = [self._subject(words[k][0], words[k][1]) for k in rest if k not in place]
        return Reading("body", "".join(single_vowels(words[k][0]) for k in place), kind, subject)

    def _person(self, text, words):
        titled = [k for k, (w, *_) in enumerate(words) if w in TITLES or self._nearest(w, TITLES, 2, 8)]
        if len(titled) == len(words):
            titled = []
        words = [w for k, w in enumerate(words) if k not in titled]
        parts, sure = [single_vowels(w[0]) for w in words if len(w[0]) > 1 and w[0] not in NOBILIARY], True
        comma = text.find(",")
        upper = [k for k, w in enumerate(words) if w[2].isupper() and len(w[2]) > 1]
        known = lambda w: self._given(w) is not None
        if comma > 0 and any(w[3] > comma for w in words) and any(w[3] < comma for w in words):
            family, given = [w for w in words if w[3] < comma], [w for w in words if w[3] > comma]
        elif upper and any(not w[2].isupper() for w in words):
            family = [words[k] for k in range(upper[0], upper[-1] + 1)]
            given = [w for w in words if w not in family]
        elif len(words) == 1:
            family, given = words, []
        elif len(words[0][0]) == 1 or known(words[0][0]):
            family, given = words[1:], words[:1]
        elif len(words[-1][0]) == 1 or words[-1][0] in _FORMAL and len(words) > 2 and not titled:
            family, given = words[:-1], words[-1:]
        elif titled:
            family, given, sure = words, [], False
        else:
            family, given, sure = words[1:], words[:1], False
        given = [w[0] for w in given]
        while len(family) > 1 and len(family[0][0]) == 1:  # middle initials
            family = family[1:]
        names = [w[0] for w in family]
        if len(names) > 1:
            names = [p for k, p in enumerate(names) if not (0 < k < len(names) - 1 and (p in NOBILIARY or 2 <= len(p) <= 4 and distance(p, "von", 1) <= 1))]
            names = [p[:-3] if k + 1 < len(names) and p.endswith("von") and len(p) > 6 else p for k, p in enumerate(names)]
            names = [p[3:] if k and p.startswith("von") and len(p) > 6 else p for k, p in enumerate(names)]
        first = next((g for g in given if len(g) > 1), given[0] if given else "")
        return Reading("person", "".join(map(single_vowels, names)), (self._given(first) or first) if first else "", [], sorted(parts), sure)

    def distinctive(self, r: Reading) -> list[str]:
        """The parts by which bands find a reading: names that are neither frequent nor known given names, or all; of bodies, the place.

        Pairs that fit only by what is left out here are proposed by :func:`part_candidates`."""
        own = [p for p in r.parts if p not in self.frequent and p not in _FORMAL]
        return own or r.parts or [r.core]

    def _given(self, w: str) -> str | None:
        if len(w) < 2:
            return None
        if w in _FORMAL:
            return w
        # of several known names one edit away, one that is common in these data is meant
        return self._nearest(w, self._common_given, 4, 5) or self._nearest(w, _FORMAL, 3, 5)


def _given_fit(a: str, b: str) -> float:
    """How well two given names fit: 1 the same person's, 0 another's; 0.9 if one is only an initial, 0.85 if one is lacking."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.85
    fa, fb = _FORMAL.get(a, frozenset((a,))), _FORMAL.get(b, frozenset((b,)))
    if len(a) == 1 or len(b) == 1:
        return 0.9 if {x[0] for x in fa | {a}} & {x[0] for x in fb | {b}} else 0.0
    if fa & fb:
        return 0.97
    return 0.93 if a not in _FORMAL and b not in _FORMAL and min(len(a), len(b)) > 3 and distance(a, b, 1) <= 1 else 0.0


def _core_fit(a: str, b: str) -> float:
    """How well two family names or places fit, by edits; a part left out at the end costs a little."""
    if a == b:
        return 1.0
    short, long = sorted((len(a), len(b)))
    d = distance(a, b, 2)
    if d == 1 and short >= 4 or d == 2 and short >= 9:
        return 1 - d / long
    if short >= 5 and long - short <= 9 and (a.startswith(b) or b.startswith(a)):
        return 0.88
    return 0.0


def _word_fit(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)):
        return 0.95
    return 0.9 if min(len(a), len(b)) >= 3 and distance(a, b, 1) <= 1 else 0.0


def _parts_fit(a: Reading, b: Reading) -> float:
    """How well the names of two people fit in the best order of them, where one of the two does not show the order; 0 if a name fits none."""
    if a.sure and b.sure or len(a.parts) != len(b.parts) or not 2 <= len(a.parts) <= 4:
        return 0.0

    def fit(x: str, y: str) -> float:
        core = _core_fit(x, y)
        return core if core not in (0.0, 0.88) else 0.97 if _FORMAL.get(x, frozenset((x,))) & _FORMAL.get(y, frozenset((y,))) else 0.0

    best = 0.0
    for order in permutations(b.parts):
        fits = [fit(x, y) for x, y in zip(a.parts, order)]
        if 0.0 not in fits:
            best = max(best, 0.98 * sum(fits) / len(fits))
    return best


def similarity(a: Reading, b: Reading) -> float:
    """Monge–Elkan similarity of two spellings read by :class:`Reader`: the mean, over the parts
    of either, of the best fit among the other's parts; 0 where a part fits none."""
    if a.kind != b.kind or not a.kind:
        return 0.0
    core = _core_fit(a.core, b.core)
    if a.kind == "person":
        given = _given_fit(a.given, b.given) if core and not (core == 0.88 and (not a.given or not b.given)) else 0.0
        return (core + given) / 2 if given else _parts_fit(a, b)
    if core in (0.0, 0.88):
        return 0.0
    if a.kind in ("delegation", "other"):
        return core
    for x, y in ((a, b), (b, a)):
        if x.subject and x.subject[0].startswith("~"):  # initials of kind and subject
            if y.subject and y.subject[0].startswith("~"):
                return (core + 1) / 2 if x.subject == y.subject else 0.0
            return (core + 0.9) / 2 if x.subject[0][1:] == _initials(y) else 0.0
    if a.given != b.given or bool(a.subject) != bool(b.subject):
        return 0.0
    fits = [max((_word_fit(x, y) for y in other), default=0.0) for mine, other in ((a.subject, b.subject), (b.subject, a.subject)) for x in mine]
    return 0.0 if 0.0 in fits else (core + 1 + sum(fits) / max(1, len(fits))) / 3


def _initials(r: Reading) -> str:
    return r.given[:1] + "".join(w[0] for w in r.subject)


def meeting_keys(r: Reading) -> tuple[set[str], set[str], set[str]]:
    """(shared, offered, sought): two readings of cores that fit can only be similar if they share a key, or one seeks a key that the other offers.

    Only readings that leave something out seek, so that many people of one family name do not all meet.
    """
    if r.kind == "person":
        if not r.given:
            return set(), {"*"}, {"*"}
        forms = _FORMAL.get(r.given, frozenset((r.given,)))
        offered = {"*"} | {"i" + f[0] for f in forms | {r.given}}
        if len(r.given) == 1:
            return {r.given}, offered, {"i" + r.given}
        shared = set(forms)
        if r.given not in _FORMAL and len(r.given) > 3:  # one edit or swap of neighbours is undone by a deletion from either
            shared |= {"-" + r.given[:i] + r.given[i + 1 :] for i in range(len(r.given))} | {"-" + r.given}
        return shared, offered, set()
    if r.kind == "body":
        if r.subject and r.subject[0].startswith("~"):
            return {r.subject[0]}, set(), {"a" + r.subject[0][1:]}
        return {"b" + r.given}, {"a" + _initials(r)}, set()
    return {r.kind}, set(), set()


def minima(part_lists: list[list[str]], hashes: int) -> np.ndarray:
    """(lists, hashes) MinHash minima of the padded q-grams of each list of parts, which is not empty."""
    number: dict[str, int] = {}
    grams, ends = [], [0]
    for parts in part_lists:
        mine = {padded[k : k + _Q] for p in parts for padded in [f"{'^' * (_Q - 1)}{p}{'$' * (_Q - 1)}"] for k in range(len(padded) - _Q + 1)}
        grams += [number.setdefault(g, len(number)) for g in mine]
        ends.append(len(grams))
    base = np.array([xxhash.xxh64_intdigest(g) for g in number], dtype=np.uint64)
    place, starts = np.array(grams), np.array(ends[:-1])
    seeds = mix64(np.arange(1, hashes + 1, dtype=np.uint64))
    return np.stack([np.minimum.reduceat(mix64(base ^ s)[place], starts) for s in seeds], axis=1)


_READING = "kind string, core string, given string, subject array<string>, parts array<string>, sure boolean"
_FIELDS = Reading._fields


def _read_all(common: dict[str, int]):
    types = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(common)
        for batch in batches:
            names = batch["name"].to_pylist()
            rows = [reader.read(n) for n in names]
            yield pa.RecordBatch.from_pydict({"name": names, **{f: pa.array([r[k] for r in rows], types[k]) for k, f in enumerate(_FIELDS)}})

    return run


def _readings(batch: pa.RecordBatch, suffix: str = "") -> list[Reading]:
    return [Reading(*r) for r in zip(*(batch[f + suffix].to_pylist() for f in _FIELDS))]


def _bands(common: dict[str, int], bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(common)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                keys = band_keys(minima([reader.distinctive(r) for r in _readings(part)], bands * _ROWS), _ROWS)
                unsure = np.repeat(~np.asarray(part["sure"].to_numpy(zero_copy_only=False)), bands)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(part["nid"]), bands)), pa.array(keys.reshape(-1)), pa.array(unsure)], names=["cid", "band", "unsure"])

    return run


_ROLES = ("shared", "offered", "sought")


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [[[f"{r.kind}:{k}" for k in keys] for keys in meeting_keys(r)] for r in _readings(batch)]
        yield pa.RecordBatch.from_arrays([batch["nid"], batch["core"], *(pa.array([r[k] for r in rows], pa.list_(pa.string())) for k in range(3))], names=["nid", "core", *_ROLES])


def edit_keys(core: str) -> set[str]:
    """Keys of which two cores share one if :func:`_core_fit` accepts them by edits: one from 4 letters on, two from 9 on.

    An edit or swap is undone by a deletion from either core, so up to 26 letters all deletions are keys.
    Beyond 24, two edits or swaps touch at most four of five pieces of a core; the piece left stands in
    the other core, which is up to two letters longer or shorter, at most two places off.
    """
    n = len(core)
    if n < 4:
        return set()
    out: set[str] = set()
    if n <= _WHOLE + 2:
        out.add(core)
        out.update(core[:i] + core[i + 1 :] for i in range(n))
        if n >= 9:
            out.update(core[:i] + core[i + 1 : j] + core[j + 1 :] for j in range(n) for i in range(j))
    if n > _WHOLE:
        for size in range(n - 2, n + 3):
            for k in range(5):
                lo, hi = size * k // 5, size * (k + 1) // 5
                out.update(f"{size}\x01{k}\x01{core[lo + off : hi + off]}" for off in range(-2, 3) if lo + off >= 0 and hi + off <= n)
    return out


def _edit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cores = batch["core"].to_pylist()
        for lo in range(0, len(cores), 2000):
            keys = [edit_keys(c) for c in cores[lo : lo + 2000]]
            flat = np.fromiter((xxhash.xxh64_intdigest(k.encode()) for ks in keys for k in ks), dtype=np.uint64)
            core = batch["core"].take(pa.array(np.repeat(np.arange(lo, lo + len(keys)), [len(ks) for ks in keys])))
            yield pa.RecordBatch.from_arrays([core, pa.array(flat.view(np.int64))], names=["core", "key"])


def core_pairs(cores: DataFrame) -> DataFrame:
    """(core_a, core_b), core_a < core_b, once each: all pairs of different cores that :func:`_core_fit` accepts, and some others.

    cores: (core), distinct and not null.
    """
    keys = Staged(cores.mapInArrow(_edit_keys, "core string, key long"), "keys")
    a, b = keys.df.select("key", F.col("core").alias("core_a")), keys.df.select("key", F.col("core").alias("core_b"))
    edited = a.join(b, "key").filter((F.col("core_a") < F.col("core_b")) & (F.levenshtein("core_a", "core_b") <= 4)).select("core_a", "core_b")
    # a part left out at the end, of at most nine letters; the shorter core is the lesser one
    n = F.length("core")
    starts = cores.filter(n > 5).select(F.explode(F.transform(F.sequence(F.greatest(F.lit(5), n - 9), n - 1), lambda k: F.substring("core", F.lit(1), k))).alias("core_a"), F.col("core").alias("core_b"))
    left_out = starts.join(cores.select(F.col("core").alias("core_a")), "core_a").select("core_a", "core_b")
    pairs = stage(edited.unionByName(left_out).distinct(), "pairs")
    keys.drop()
    return pairs


def part_candidates(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(nid_a, nid_b), nid_a < nid_b: all pairs of readings (nid, parts, sure) that :func:`_parts_fit` accepts, and some others.

    pairs: (core_a, core_b), all pairs of different parts that fit by edits. Each reading of unsure order looks,
    by that of its parts which fits parts of the fewest readings, for readings of as many parts; those stay in
    which each part may fit one of the other's, either way. No part is too frequent to be looked for.
    """
    name = lambda p: F.named_struct(F.lit("p"), p, F.lit("known"), p.isin(list(_FORMAL)))
    people = nodes.filter("kind = 'person' and size(parts) between 2 and 4").select("nid", "sure", F.size("parts").alias("n"), F.transform("parts", name).alias("names"), F.explode(F.array_distinct("parts")).alias("part"))
    people = stage(people, "parts")
    close = lambda x, y: F.levenshtein(x, y) <= F.when(F.least(F.length(x), F.length(y)) < 9, 2).otherwise(4)
    edited = pairs.filter(close(F.col("core_a"), F.col("core_b")))
    forms = nodes.sparkSession.createDataFrame([(x, y) for x, f in _FORMAL.items() for y, g in _FORMAL.items() if x != y and f & g], "part string, near string")
    near = edited.select(F.col("core_a").alias("part"), F.col("core_b").alias("near")).unionByName(edited.select(F.col("core_b").alias("part"), F.col("core_a").alias("near"))).unionByName(forms)
    near = stage(near.unionByName(people.select("part", F.col("part").alias("near")).distinct()), "near")
    unsure = people.filter("not sure")
    held = people.groupBy(F.col("part").alias("near"), "n").agg(F.count(F.lit(1)).alias("held"))
    found = unsure.select("part", "n").distinct().join(near, "part").join(held, ["near", "n"]).groupBy("part", "n").agg(F.sum("held").alias("found"))
    least = unsure.join(found, ["part", "n"]).groupBy("nid", "n").agg(F.min(F.struct("found", "part"))["part"].alias("part"), F.first("names").alias("names"))
    a = least.join(near, "part").select("near", "n", F.col("nid").alias("nid_a"), F.col("names").alias("names_a"))
    b = people.select(F.col("part").alias("near"), "n", F.col("nid").alias("nid_b"), F.col("names").alias("names_b"))
    may = lambda x, y: close(x["p"], y["p"]) | (x["known"] & y["known"])
    all_of = lambda one, other: F.forall(one, lambda x: F.exists(other, lambda y: may(x, y)))
    met = a.join(b, ["near", "n"]).filter((F.col("nid_a") != F.col("nid_b")) & all_of("names_a", "names_b") & all_of("names_b", "names_a"))
    return met.select(F.least("nid_a", "nid_b").alias("nid_a"), F.greatest("nid_a", "nid_b").alias("nid_b"))


def candidates(nodes: DataFrame, common: dict[str, int]) -> DataFrame:
    """(nid_a, nid_b), nid_a < nid_b, once each: pairs of readings (nid, core, ..) that may be similar, all that are among them.

    Where the order of one's names is not sure, those that share a band of MinHash samples of their distinctive
    parts, and all whose parts fit. Where it is, cores can be compared, which are often too short for the collision
    curve: all pairs of cores that fit and of a meeting key.
    """
    bands = nodes.mapInArrow(_bands(common, bands_for(_BANDED[0], _ROWS, _BANDED[1])), "cid long, band long, unsure boolean")
    banded = banded_pairs(stage(bands, "bands"), fits=F.col("unsure_a") | F.col("unsure_b")).select(F.col("cid_a").alias("nid_a"), F.col("cid_b").alias("nid_b"))
    keys = stage(nodes.mapInArrow(_meeting, "nid long, core string, shared array<string>, offered array<string>, sought array<string>"), "meeting")
    cores = stage(nodes.select("core").distinct(), "cores")
    of_parts = nodes.filter("kind = 'person'").select(F.explode("parts").alias("core"))
    pairs = core_pairs(stage(cores.unionByName(of_parts).distinct(), "terms"))
    fits = pairs.unionByName(pairs.select(F.col("core_b").alias("core_a"), F.col("core_a").alias("core_b"))).unionByName(cores.select(F.col("core").alias("core_a"), F.col("core").alias("core_b")))
    side = lambda role, x: keys.select(F.col("core").alias(f"core_{x}"), F.explode(role).alias("key"), F.col("nid").alias(f"nid_{x}"))
    shared = side("shared", "a").join(fits, "core_a").join(side("shared", "b"), ["core_b", "key"]).filter("nid_a < nid_b").select("nid_a", "nid_b")
    sought = side("sought", "a").join(fits, "core_a").join(side("offered", "b"), ["core_b", "key"]).filter("nid_a <> nid_b").select(F.least("nid_a", "nid_b").alias("nid_a"), F.greatest("nid_a", "nid_b").alias("nid_b"))
    return banded.unionByName(part_candidates(nodes, pairs)).unionByName(shared).unionByName(sought).distinct()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sim = np.fromiter(map(similarity, _readings(batch, "_a"), _readings(batch, "_b")), dtype=np.float64, count=batch.num_rows)
        keep = pa.array(sim > 0)
        yield pa.RecordBatch.from_arrays([batch["node_a"].filter(keep), batch["node_b"].filter(keep), pa.array(sim).filter(keep)], names=["node_a", "node_b", "sim"])


def star_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, centre): star clustering of an undirected graph.

    nodes: (node, rank, n), larger ranks rather being centres; edges: (node_a,
    node_b, sim), each once. In each round every free node that outranks all its
    free neighbours, by rank, degree, n and id, becomes a centre; free
    neighbours of centres become satellites of the best one, by similarity, then
    priority. Nodes without edges are their own centres. Rounds end when no node
    is free.
    """
    both = edges.select(F.col("node_a").alias("x"), F.col("node_b").alias("y"), "sim").unionByName(edges.select(F.col("node_b").alias("x"), F.col("node_a").alias("y"), "sim"))
    degree = both.groupBy("x").agg(F.count("*").alias("degree"))
    ranked = nodes.join(degree, nodes["node"] == degree["x"], "left").select("node", F.struct("rank", F.coalesce("degree", F.lit(0)).alias("degree"), "n", "node").alias("p"))
    ranked = Staged(ranked, "ranked")
    pri = ranked.df.select(F.col("node").alias("k"), "p")
    arcs = Staged(both.join(pri.withColumnRenamed("p", "px"), F.col("x") == F.col("k")).drop("k").join(pri.withColumnRenamed("p", "py"), F.col("y") == F.col("k")).drop("k"), "arcs")
    lone = ranked.df.join(arcs.df.select(F.col("x").alias("node")).distinct(), "node", "left_anti").select("node", F.col("node").alias("centre"))
    parts = [stage(lone, "lone")]
    while arcs.df.limit(1).count():
        a = arcs.df
        tops = Staged(a.groupBy("x").agg(F.max("py").alias("best"), F.first("px").alias("px")).filter("px > best").select(F.col("x").alias("centre")), "centres")
        sats = Staged(a.join(tops.df.withColumnRenamed("centre", "x"), "x").groupBy(F.col("y").alias("node")).agg(F.max(F.struct(F.round("sim", 2).alias("s"), "px", F.col("x").alias("centre"))).alias("b")).select("node", F.col("b.centre").alias("centre")), "satellites")
        parts += [tops.df.select(F.col("centre").alias("node"), "centre"), sats.df]
        taken = tops.df.select(F.col("centre").alias("node")).unionByName(sats.df.select("node"))
        left = a.join(taken.withColumnRenamed("node", "x"), "x", "left_anti")
        gone = left.join(taken.withColumnRenamed("node", "y"), "y", "left_anti")
        new = Staged(gone, "arcs")
        alone = Staged(left.select(F.col("x").alias("node"), "px").distinct().join(new.df.select(F.col("x").alias("node")).distinct(), "node", "left_anti").select("node", F.col("node").alias("centre")), "alone")
        parts.append(alone.df)
        arcs.drop()
        arcs = new
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def link_names(names: DataFrame, common_share: int = 500) -> DataFrame:
    """(name, entity) of each distinct non-blank ``name``; spellings of one entity share ``entity``.

    All cores that the verifier can accept are compared. Common words are those in
    more than one of ``common_share`` spellings, hence a bounded number. Null and blank
    names are left out; placeholders such as 'Unknown' are entities of their
    own. Repeated names count once. An empty input gives an empty result.
    """
    spelled = names.select("name").filter(F.trim(F.regexp_replace("name", r"\s+", " ")) != "").distinct()
    spelled = Staged(spelled, "spellings", n=F.count(F.lit(1)))
    names, total = spelled.df, spelled.seen["n"]
    words = names.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))).alias("w")).groupBy("w").count()
    common: dict[str, int] = {}
    for r in words.filter((F.length("w") > 2) & (F.col("count") >= max(4, total // common_share))).collect():
        w = fold(r["w"])
        if w not in LINKING and w not in NOBILIARY:
            common[w] = common.get(w, 0) + r["count"]
    parsed = names.mapInArrow(_read_all(common), f"name string, {_READING}")
    parsed = parsed.withColumn("node", F.when(F.col("kind") == "", F.concat(F.lit("?"), "name")).otherwise(F.concat_ws("|", "kind", "core", "given", F.array_join("subject", " "), F.when(~F.col("sure"), F.array_join("parts", " ")))))
    parsed = stage(parsed, "read")
    # people with a full name and bodies in full make better centres
    rank = F.when((F.col("given") == "") & (F.col("kind") == "person") | F.coalesce(F.get("subject", F.lit(0)).startswith("~"), F.lit(False)), 0).when((F.length("given") == 1) & (F.col("kind") == "person"), 1).otherwise(2)
    same = parsed.groupBy("node", "kind", "core", "given", "subject", "sure").agg(F.count("*").alias("n"), F.min("parts").alias("parts"))
    nodes = stage(same.withColumn("rank", rank).withColumn("nid", F.monotonically_increasing_id()), "nodes")
    real = nodes.filter("kind <> '' and core <> ''").select("nid", "node", *_FIELDS)
    pairs = candidates(real, common)
    side = lambda x: real.select(*[F.col(c).alias(f"{c}_{x}") for c in real.columns])
    cand = pairs.join(side("a"), "nid_a").join(side("b"), "nid_b").filter("kind_a = kind_b")
    edges = stage(cand.mapInArrow(_verify, "node_a string, node_b string, sim double"), "links")
    clusters = star_clusters(nodes.select("node", "rank", "n"), edges)
    return parsed.select("name", "node").join(clusters, "node").select("name", F.col("centre").alias("entity"))


def typed_names(lanes: DataFrame) -> DataFrame:
    """All spellings of swimlanes: stakeholder lanes' names and actors of events, as stored."""
    lane = lanes.filter("group_by = 'stakeholder'").select("name")
    actors = lanes.select(F.explode("lane_events.actors").alias("actors")).select(F.explode("actors").alias("name"))
    return lane.unionByName(actors)


def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    return link_names(typed_names(spark.read.parquet(f"{d}/swimlanes.parquet")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of spellings of an entity; TESTDATA.md asks for each."""
    e = stage(p1_entities(spark, d), "entities")
    a, b = e.select("entity", F.col("name").alias("name_a")), e.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b")
