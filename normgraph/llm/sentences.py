"""Sentence boundaries across languages and scripts.

Blank lines split a text into blocks. In a block, marks, line breaks and, in
Thai, blanks are candidate ends, each with a score of how well the words before
it close a sentence and those after it open one. Semi-Markov dynamic programming
then selects whole spans, scoring openings, closings, lengths and the balance of
quotation marks and brackets jointly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

# Abbreviations after which a sentence goes on, by language (en de fr es ru el ar hi).
LEADING = frozenset("""
Art art Arts arts sec Sec secs SEC Ch ch Reg reg Regs para Para paras approx Dr Mr Mrs Ms Prof Hon Amb Gen Sen Rep Gov Rev St cf Doc doc Ver ver Vol vol Fig fig pp viz vs incl esp
Abs Nr nr Bd Hr Fr Frl gem vgl ca bzw Kap Ziff bspw sog
al env Mme Mlle MM chap éd
núm párr aprox pág págs Sr Sra Srta Dra cap
ст п пп см напр тыс млн млрд акад Акад проф Проф ул гл рис им
άρθρ παρ αριθ βλ δηλ κ κκ σελ κεφ
ص د م
अनु सं पृ डॉ श्री खं
""".split())  # fmt: skip
# Months of German dates, which follow an ordinal with a point.
MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())
# Words that do not end a sentence, by language (en de fr es ru el).
UNFINISHED = frozenset("""
the a an of in on at by for to and or with from under over as that than into per any each every no its their is are was were be been shall may must not
der die das den dem des ein eine einen einer einem und oder mit von vom aus im am zum zur bei für auf über unter bis durch nach
à le la les l un une des du de et ou avec sans sous sur dans en au aux par pour
el los las una unos y o con sin sobre por del al para
и или в во на с со по к о об от до из при для не
ο η το οι τα του της των τον την και ή με σε στο στη στην στον στις για από
""".split())  # fmt: skip

_BLANK_LINE = regex.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85  ])(?:[^\S\n\r]*(?:\r\n|[\n\r\x0b\x0c\x85  ]))+| ")
_LINE = regex.compile(r"\r\n|[\n\r\x0b\x0c\x85 ]")
_THAI = regex.compile(r"\p{Thai}")
_QUOTES = regex.compile(r"[“”„«»‹›‘’\"「」『』()（）\[\]]")
_WORD_BEFORE = regex.compile(r"(?r)[\p{L}\p{M}\p{N}]+")
_LIST = regex.compile(r"\s*(?:(?P<bullet>[–•・*▪●◦‣-])|[(（]\p{N}{1,4}[)）]|[(（]\p{L}[)）]|\p{L}\)|\p{N}{1,4}[)）]|\p{N}{1,4}、|(?P<number>\p{N}{1,4}(?:(?:\.\p{N}+)+|\.)\s(?=\S)))")
_ENDS = r"(?P<mark>(?:\.(?![\p{Ll}\p{N}])|[。．｡!?！？।॥؟۔…;;])+)"
_CLOSE = r"(?P<close>(?:[”’\"»›」』)）\]“]|[    ][»›](?!\p{L}))*)"
_CANDIDATE = regex.compile(_ENDS + _CLOSE + r"(?P<gap>\s*)|(?P<line>[^\S\n\r]*(?:\r\n|[\n\r\x0b\x0c\x85 ])\s*)")
_CANDIDATE_THAI = regex.compile(_CANDIDATE.pattern + r"|(?P<blank>[^\S\n\r]+)")
_PAIR = {"“": "”", "„": "“", "«": "»", "‹": "›", "‘": "’", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]"}
_WIDE = "。．｡！？।॥"
_UNBALANCED = 6.0  # more than any end is worth


def _wrap_width(lines: list[str]) -> tuple[int, float]:
    """The least width of the wrapped lines of a text, and how sure it is that it was wrapped: 0, 0.5 or 1.

    A wrapped line has at least the width, and would not without its last word;
    the width that most line breaks agree with is taken.
    """
    low, high, unended = [], [], True
    for a, b in zip(lines, lines[1:]):
        a = a.strip()
        if a and b and not b.isspace():
            n, last = len(a), len(a.rsplit(None, 1)[-1])
            low.append(n - last if last <= 25 else n + 1)
            high.append(n)
            unended = unended and a[-1] not in ".!?؟।。:;：；"
    if len(low) < 3:  # too few to count: lines of like and usual length, none with an end mark
        return min(high, default=0), 0.5 * (bool(low) and unended and max(low) <= min(high) and 40 <= min(high) <= 86)
    best, width = 0, 0
    for w in set(high):
        if 30 <= w <= 130:
            agree = sum(1 for x, y in zip(low, high) if x <= w <= y)
            if agree > best or agree == best and w < width:
                best, width = agree, w
    return width, float(best >= max(3, 0.5 * len(low)))


def _nature(text: str, at: int) -> str:
    """What stands at a place: 'U' a capital, 'l' a small letter, 'o' a letter without case, 'd' a digit,
    'q' an opening mark, '-' a dash, 'c' what continues a sentence, 's' another sign."""
    c = text[at]
    if c.isalpha():
        if c.islower():
            after = text[at + 1 : at + 2]
            return "U" if after.isupper() else "l"
        return "U" if c.isupper() or c.istitle() else "o"
    if c.isdigit():
        return "d"
    if c in "“„«‹‘「『\"'(（[¿¡":
        return "c" if text.startswith("[…]", at) else "q"
    if c in "—–-−":
        return "-"
    if c in ",;:%&)]}/»”’」』）、，；：%":
        return "c"
    return "s"


def _after_point(text: str, at: int, gap: str, nxt: int, kind: str, closers: str, fresh: bool) -> float:
    """Score of an end at a single point at ``at``; ``fresh``: a line begins at the number before it."""
    m = _WORD_BEFORE.match(text, max(0, at - 40), at)
    tok = m.group() if m else ""
    before = text[m.start() - 1] if m and m.start() else " "
    if not gap and not closers:
        if kind == "U" and (len(tok) > 1 and (tok[-1].islower() or tok.isdigit() or len(tok) > 3) or not tok and text[at - 1] in "]%)”»"):
            return -4.0 if tok in LEADING else 2.5
        return 1.5 if kind == "o" and len(tok) > 1 and tok not in LEADING and not tok[-1].isdigit() and "؀" <= tok[-1] <= "ۿ" else -9.0
    if closers:
        return {"U": 4.0, "o": 4.0, "q": 4.0, "d": 2.0, "s": 2.0}.get(kind, -4.0)
    if tok in LEADING:
        return -4.0
    if kind in "l-c":
        return -4.0
    if len(tok) == 1 and tok.isalpha():
        word = _NEXT.match(text, nxt)
        if word and len(word.group(1)) == 1:  # another initial: z. B.
            return -4.0
        if tok.isupper() or kind == "o" and not tok.islower():
            return -3.0
        return 2.5 if kind in "Uoqs" else -4.0
    if tok.isdigit():
        if fresh:
            return -4.0
        word = _NEXT_WORD.match(text, nxt)
        if word and word.group() in MONTHS:
            return -4.0
    if tok and "ऀ" <= tok[-1] <= "ॿ" and kind == "o":
        return -4.0
    if kind == "d":
        return 1.5 if (len(tok) > 3 or not tok) and not tok.isdigit() else -3.0
    if tok == "No" and before not in " \n\r\t":
        return -1.0
    return 4.0


_DANGLING = regex.compile(r"[\p{L}\p{M}\p{N}%)\]]{2,}[.!?»”“\"]+\s+(?:\p{Lu}[\p{L}-]{0,5}|\p{L}\.)$")  # a short word alone after an end, at the end of a line
_HEADING = regex.compile(r"\p{N}+\.\s+\p{Lu}")
_GREEK = regex.compile(r"\p{Greek}[^\p{L}]*$")
_NEXT = regex.compile(r"(\p{L})\.")
_NEXT_WORD = regex.compile(r"\p{L}+")


class _Block:
    """Candidates of one block of a text, and the choice among them."""

    __slots__ = ("text", "lo", "hi", "width", "wrapped")

    def __init__(self, text: str, lo: int, hi: int, width: int, wrapped: float):
        self.text, self.lo, self.hi, self.width, self.wrapped = text, lo, hi, width, wrapped

    def _line_break(self, at: int, nxt: int, kind: str) -> tuple[float, bool]:
        """Score of a line break without an end mark before it, and whether it only wraps a line."""
        text = self.text
        start = max(text.rfind("\n", self.lo, at), text.rfind("\r", self.lo, at)) + 1
        start = max(start, self.lo)
        line = text[start:at].rstrip()
        wraps = self.wrapped > 0.5 * (kind == "U") and len(line) >= self.width - 2 and len(line) - len(line.rsplit(None, 1)[-1]) - 3 < self.width
        m = _LIST.match(text, nxt, self.hi)
        last = line[-1:] or " "
        tail = _WORD_BEFORE.match(line.rstrip("."))
        if tail and last == "." and tail.group() in LEADING or _DANGLING.search(line, max(0, len(line) - 16)):
            return -3.0, True
        if m:
            in_list = last in ":;：；" or _LIST.match(line) is not None
            if in_list or not m.group("number") and (not wraps or m.group("bullet") and m.group("bullet") not in "-*"):
                return 5.0, False
        if last in ":：" and not wraps:
            return 4.0, False
        if wraps:
            return -4.0, True
        if kind in "lc" or last in ",،、，&" or (kind == "-" and last not in ".!?"):
            return -3.0, True
        if kind == "d" and last not in ".!?؟।。" and not (m and m.group("number") and _HEADING.match(text, nxt)):
            return -2.4, True  # a number goes on with what was said
        if tail and last != "." and tail.group().lower() in UNFINISHED and kind not in "o":
            return -2.0, True
        return 4.0, False

    def candidates(self) -> list[tuple[int, int, float]]:
        """(end, next start, score) of ends of positive score, in order: no cost of a span outweighs a negative one."""
        text, lo, hi, out = self.text, self.lo, self.hi, []
        thai = _THAI.search(text, lo, hi) is not None
        fresh = lo  # where the current hard line begins
        for m in (_CANDIDATE_THAI if thai else _CANDIDATE).finditer(text, lo, hi):
            nxt = m.end()
            if nxt >= hi:
                break
            group = m.lastgroup
            kind = _nature(text, nxt)
            if group == "line":
                end = m.start()
                score, wraps = self._line_break(end, nxt, kind)
                if not wraps:
                    fresh = nxt
                elif thai and end > lo:
                    score = self._thai(end, nxt, score)
            elif group == "blank":
                end = m.start()
                score = self._thai(end, nxt, -9.0) if end > lo else -9.0
            else:
                mark, closers, gap = m.group("mark"), m.group("close"), m.group("gap")
                end = m.end("close")
                at = m.start()
                wraps = True
                broken = bool(gap) and _LINE.search(gap) is not None
                if broken:
                    at_line, wraps = self._line_break(end, nxt, kind)
                if "“" in closers and not self._closes_low(at, m.start("close")):
                    # an opening mark, not the close of a low one
                    cut = m.start("close") + closers.index("“")
                    end, nxt, closers, gap, kind = cut, cut, closers[: closers.index("“")], "", "q"
                score = self._mark(mark, closers, gap, at, end, nxt, kind, fresh)
                if broken and not wraps:
                    if kind not in "lc" and score > -4.0 or at_line >= 5.0:
                        score = max(score, at_line)
                    if score > 0:
                        fresh = nxt
            if score > 0 and end > lo:
                out.append((end, nxt, score))
        return out

    def _closes_low(self, at: int, close: int) -> bool:
        """Whether a high mark like “ at ``close`` ends a quotation begun by a low one."""
        low = self.text.rfind("„", self.lo, close)
        return low >= 0 and self.text.find("“", low, close) < 0

    def _thai(self, end: int, nxt: int, otherwise: float) -> float:
        a, b = self.text[end - 1], self.text[nxt]
        if not ("฀" <= a <= "๿" or "฀" <= b <= "๿"):
            return otherwise
        return -4.0 if a.isdigit() or b.isdigit() or a == "ๆ" or b == "ๆ" else 4.0

    def _mark(self, mark, closers, gap, at, end, nxt, kind, fresh) -> float:
        text = self.text
        first = mark[0]
        if first in ";;":
            return 3.0 if kind in "Uq" and (gap or closers) and _GREEK.search(text, max(0, at - 12), at) else -9.0
        if "…" in mark or mark.startswith("..."):
            if mark[-1] in "。.!?" and len(mark) > 1 and "…" in mark:
                return 4.0 if kind in "Uoqds" else -3.0
            if closers[:1] == "]" or text[at - 1 : at] == "[":
                return 1.0 if kind == "U" and gap else -4.0
            return 1.5 if kind in "Uq" and gap else -3.0
        if first in _WIDE and first not in "।॥":
            if closers and any(c in "”」』’»" for c in closers):
                return -3.0 if not _LINE.search(gap) else 2.0
            return -3.0 if kind in "c" else 4.0
        if first == "." and len(mark) == 1:
            return _after_point(text, at, gap, nxt, kind, closers, self._numbered(fresh, at))
        if mark == "..":
            return 4.0 if kind in "Uoqs" else -3.0
        # ! ? and danda
        if kind in "l-c":
            return -3.0
        if closers and kind == "o":
            return -3.0 if not gap else 2.0
        return 4.0 if gap or closers or kind in "Uoq" else -9.0

    def _numbered(self, start: int, at: int) -> bool:
        """Whether all of a hard line before a point is a number, perhaps with a word such as Sec. or a § before it."""
        return at - start <= 24 and _NUMBERED.fullmatch(self.text, start, at) is not None

    def choose(self) -> list[tuple[int, int]]:
        """Spans of the block's units: those of the largest sum of scores.

        A span has the score of how it closes, less what its length and its opening cost, and less a charge
        for every quotation or bracket that it ends within.
        """
        text, lo, hi = self.text, self.lo, self.hi
        cand = self.candidates()
        if cand and _QUOTES.search(text, lo, hi):
            depth = self._depths([c[0] for c in cand])
            cand = [(end, nxt, score - _UNBALANCED * d) for (end, nxt, score), d in zip(cand, depth)]
            cand = [c for c in cand if c[2] > 0]
        if not cand:
            return [(lo, hi)]
        n = len(cand)
        ends = [c[0] for c in cand] + [hi]
        starts = [lo] + [c[1] for c in cand]
        gain = [0.0] + [c[2] for c in cand] + [0.0]
        best, back = [0.0] * (n + 2), [0] * (n + 2)
        most = [0.0] * (n + 2)  # of the best scores up to each candidate
        for j in range(1, n + 2):
            top, arg = -1e18, j - 1
            for i in range(j - 1, -1, -1):
                # span from starts[i] to ends[j - 1]
                size = ends[j - 1] - starts[i]
                long = 1.0 - 450 / size if size > 900 else 0.0
                if most[i] + gain[j] - long < top - 1e-9:
                    break  # longer spans cost no less, so no earlier start is better
                s = best[i] + gain[j] - long
                if size < 3:
                    s -= 2.0 if any(c.isalnum() for c in text[starts[i] : ends[j - 1]]) else 8.0
                if i and text[starts[i]].islower() and gain[i] < 4.0:
                    s -= 0.5
                if s > top:
                    top, arg = s, i
            best[j], back[j] = top, arg
            most[j] = max(most[j - 1], top)
        out, j = [], n + 1
        while j > 0:
            i = back[j]
            out.append((starts[i], ends[j - 1]))
            j = i
        return out[::-1]

    def _depths(self, ends: list[int]) -> list[int]:
        """Number of quotations and brackets open at each end; those that the block does not close do not count."""
        text, stack, spans = self.text, [], []  # stack: (closing mark, place of the opening one)
        for m in _QUOTES.finditer(text, self.lo, self.hi):
            at, c = m.start(), m.group()
            k = len(stack) - 1
            while k >= 0 and stack[k][0] != c:
                k -= 1
            opens = c in _PAIR and not (c == "‘" and at and text[at - 1].isalpha())
            if k >= 0 and not (opens and c != "“" and c != '"') and not (c == "’" and text[at + 1 : at + 2].isalpha()):
                spans.append((stack[k][1], at))
                del stack[k:]
            elif c == '"' and not text[at + 1 : at + 2].isspace() and (at == self.lo or not text[at - 1].isalnum()):
                stack.append(('"', at))
            elif opens:
                stack.append((_PAIR[c], at))
        change: dict[int, int] = {}
        for a, b in spans:
            change[a] = change.get(a, 0) + 1
            change[b] = change.get(b, 0) - 1
        marks, out, k, depth = sorted(change), [], 0, 0
        for end in ends:
            while k < len(marks) and marks[k] < end:
                depth += change[marks[k]]
                k += 1
            out.append(depth)
        return out


_NUMBERED = regex.compile(r"\s*(?:(?:[\p{L}]{2,12}\.?|§)\s+)?[\p{N}IVXLC]{1,7}")


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence unit, in code points, end exclusive; none for a null, empty or blank text."""
    if not text or text.isspace():
        return []
    width, wrapped = _wrap_width(_LINE.split(text)) if "\n" in text or "\r" in text else (0, 0.0)
    out = []
    at = 0
    for m in [*_BLANK_LINE.finditer(text), None]:
        lo, hi = at, m.start() if m else len(text)
        if m:
            at = m.end()
        while lo < hi and text[lo].isspace():
            lo += 1
        while hi > lo and text[hi - 1].isspace():
            hi -= 1
        if lo == hi:
            continue
        for a, b in _Block(text, lo, hi, width, wrapped).choose():
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((a, b))
    return out


def _spans(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                spans = [sentence_spans(t) for t in part["text"].to_pylist()]
                n = np.array([len(s) for s in spans])
                flat = np.array([x for s in spans for x in s], dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part[key].take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=[key, "unit_start", "unit_end"])

    return run


def sentence_units(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, unit_start, unit_end) of each sentence unit of each text.

    Positions count code points from 0, end exclusive, from first to last
    non-blank character. Null, empty and blank texts have no units. Rows are
    handled one by one, repeated or not; a null key is kept. Only the two named
    columns are read, and nothing is shuffled. Whole texts are segmented,
    however long.
    """
    rows = documents.select(documents[key].alias(key), documents[text].alias("text"))
    return rows.mapInArrow(_spans(key), f"`{key}` {rows.schema[0].dataType.simpleString()}, unit_start long, unit_end long")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentence_units(spark.read.parquet(f"{d}/documents.parquet"))
