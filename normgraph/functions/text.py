"""Scalar functions over text columns: similarity, names, numerals, URIs, dates, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_set(c: Column) -> Column:
    """Distinct lower-cased words, split at blanks."""
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != ""))


def word_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of word sets in per cent, cut to an integer; 100 for two empty texts, 0 for one."""
    x, y = word_set(F.coalesce(a, F.lit(""))), word_set(F.coalesce(b, F.lit("")))
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(either == 0, 100).otherwise(F.floor(both * 100 / either)).cast("int")


def bag_similarity(a: Column, b: Column) -> Column:
    """Words of ``b`` that ``a`` has, over all words of both less those; 1 for equal texts, 0 with an empty one."""
    words = lambda c: F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != "")
    x, y = words(a), words(b)
    both = F.size(F.filter(y, lambda w: F.array_contains(x, w)))
    return F.when(F.lower(a) == F.lower(b), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def change_label(similarity: Column, base: Column, target: Column) -> Column:
    """How large a change is: minor from 80, moderate from 60, substantial from 40, else by length: expanded, condensed or rewrite."""
    a, b = F.length(base), F.length(target)
    return F.when(similarity >= 80, "minor").when(similarity >= 60, "moderate").when(similarity >= 40, "substantial").when(b > 2 * a, "expanded").when(a > 2 * b, "condensed").otherwise("rewrite")


def slug(c: Column) -> Column:
    """Term as part of a URI: lower case, blanks and hyphens to underscores, other signs dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_"), r"[^a-z0-9_]", "")


def plain_name(c: Column) -> Column:
    """Name without leading form of address or article, blanks collapsed."""
    c = F.regexp_replace(F.trim(c), r"(?i)^(mr|ms|mrs|dr|prof)\.?\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)^the\s+", ""), r"\s+", " "))


def role_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[-\s]", "")


def roman_value(c: Column) -> Column:
    """Value of a Roman numeral, null if it is none."""
    digits = F.create_map(*[F.lit(x) for pair in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in pair])
    s = F.upper(F.trim(c))
    values = F.transform(F.filter(F.split(s, ""), lambda x: x != ""), lambda x: digits[x])
    signed = F.transform(values, lambda v, i: F.when(v < F.coalesce(F.get(values, i + 1), F.lit(0)), -v).otherwise(v))
    total = F.aggregate(signed, F.lit(0), lambda acc, v: acc + v)
    return F.when(s.rlike(r"^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (s != ""), total)


def article_number(uri: Column) -> Column:
    """Number after :Art in a provision's URI."""
    return F.regexp_extract(uri, r":Art(\d+)", 1).try_cast("int")


def domain(url: Column) -> Column:
    """Host of a URL in lower case, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/:?#]+)", 1)), r"^www\.", "")


def day(c: Column) -> Column:
    """Date of texts such as '25 May 2018', 'May 25, 2018' or '2018-05-25'; null for others."""
    return F.coalesce(F.try_to_date(c, "d MMMM yyyy"), F.try_to_date(c, "MMMM d, yyyy"), F.try_to_date(c, "yyyy-MM-dd"))


def relative_day(c: Column, base: Column) -> Column:
    """Date of texts such as 'tomorrow', 'next week', 'in 3 days' or '2 weeks ago', counted from ``base``; null for others."""
    t = F.lower(F.trim(c))
    n = F.regexp_extract(t, r"(\d+)\s+(?:day|week)s?", 1).try_cast("int") * F.when(t.rlike(r"\bweeks?\b"), 7).otherwise(1)
    return (
        F.when(t == "today", base).when(t == "tomorrow", F.date_add(base, 1)).when(t == "yesterday", F.date_add(base, -1)).when(t == "next week", F.date_add(base, 7)).when(t == "next month", F.add_months(base, 1))
        .when(t.rlike(r"^in \d+ (day|week)s?$"), F.date_add(base, n)).when(t.rlike(r"^\d+ (day|week)s? ago$"), F.date_add(base, -n))
    )


def snippet(text: Column, start: Column, end: Column, around: int = 50) -> Column:
    """What stands within ``around`` characters of a place, blanks collapsed, with an ellipsis where the text goes on."""
    low, high = F.greatest(start - around, F.lit(0)), F.least(end + around, F.length(text))
    part = F.trim(F.regexp_replace(F.substring(text, low.cast("int") + 1, (high - low).cast("int")), r"\s+", " "))
    return F.concat(F.when(low > 0, "…").otherwise(""), part, F.when(high < F.length(text), "…").otherwise(""))


def bytes_text(n: Column) -> Column:
    """A number of bytes in the largest unit that it reaches, with one digit after the point: 1.5 KB."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.1f", n / float(1024**k)), F.lit(f" {unit}"))).otherwise(out)
    return out


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def seconds_text(s: Column) -> Column:
    """A number of seconds as 1h 02m 03s, without leading units that are none."""
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h.cast("long"), m.cast("long"), r.cast("long"))).when(m > 0, F.format_string("%dm %02ds", m.cast("long"), r.cast("long"))).otherwise(F.format_string("%ds", r.cast("long")))


def clause_order(c: Column) -> Column:
    """Sort key of clause numbers: the leading number, then the rest as text; texts without a number come last."""
    n = F.regexp_extract(c, r"^(\d+)", 1).try_cast("long")
    return F.struct(F.coalesce(n, F.lit(2**62)).alias("number"), F.regexp_extract(c, r"^\d*(.*)$", 1).alias("rest"))


def html_text(c: Column) -> Column:
    """Text of HTML: scripts and tags dropped, blocks as lines, the common entities resolved."""
    for pattern, to in (
        (r"(?is)<(script|style|head|noscript)\b.*?</\1\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article|table|ul|ol)\s*>", "\n"), (r"(?s)<[^>]*>", ""),
        ("&nbsp;|&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;|&#34;", '"'), ("&#39;|&apos;|&rsquo;|&lsquo;", "'"), ("&mdash;|&ndash;", "-"), ("&sect;", "§"), ("&amp;", "&"),
        (r"[ \t\x0B\f\r]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"),
    ):
        c = F.regexp_replace(c, pattern, to)
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def escape_literal(c: Column) -> Column:
    """Literal's text for N-Triples and Turtle."""
    for raw, to in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(to))
    return c


def escape_xml(c: Column) -> Column:
    for raw, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(to))
    return c
