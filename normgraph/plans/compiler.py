"""The SPARQL algebra to DataFrame plans, which Catalyst optimises.

A triple pattern is a filtered scan of the graph, a basic graph pattern a chain
of equi-joins ordered so that neighbours share variables, an OPTIONAL a left
join, and the rest maps to the DataFrame operators of the same name.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normgraph.plans.sparql import Aggregate, Call, Const, Group, Pattern, Query, SparqlError, Var, parse

#: A number as the aggregates and comparisons read it.
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\z"


def number(c: Column) -> Column:
    """Double of a numeric text, null otherwise."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def scan(triples: DataFrame, p: Pattern) -> DataFrame:
    """Bindings of one pattern: one column per variable."""
    out, seen = triples, {}
    for position, term in (("s", p.s), ("p", p.p), ("o", p.o)):
        if isinstance(term, Const):
            out = out.filter(F.col(position) == term.value)
        elif term.name in seen:
            out = out.filter(F.col(position) == F.col(seen[term.name]))
        else:
            seen[term.name] = position
    if not seen:
        return out.select(F.lit(1).alias("\x00"))
    return out.select(*[F.col(position).alias(name) for name, position in seen.items()])


def order(patterns: tuple[Pattern, ...], counts: Mapping[str, int] | None = None) -> list[Pattern]:
    """Patterns so that each, if possible, shares a variable with those before, the most selective first.

    ``counts``, triples per predicate, ranks patterns of bound predicates; without
    it, patterns with more constants count as more selective.
    """
    total = sum(counts.values()) if counts else 0

    def size(p: Pattern) -> float:
        n = float(counts.get(p.p.value, 0) if isinstance(p.p, Const) else total) if counts else 1e6
        if isinstance(p.s, Const):
            n /= 1e4
        if isinstance(p.o, Const):
            n /= 1e2
        if not counts and isinstance(p.p, Const):
            n /= 10
        return n

    left, out, bound = list(patterns), [], set()
    while left:
        joined = [p for p in left if bound & set(p.variables)] or left
        best = min(joined, key=lambda p: (size(p), left.index(p)))
        left.remove(best)
        out.append(best)
        bound |= set(best.variables)
    return out


def _join(left: DataFrame, right: DataFrame, how: str, nullable: set[str]) -> DataFrame:
    """Natural join; variables that may be unbound on the left are compatible with any value."""
    shared = [c for c in left.columns if c in right.columns and c != "\x00"]
    loose = [c for c in shared if c in nullable]
    right = right.drop("\x00") if "\x00" in left.columns else right
    if not shared:
        return left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    if not loose:
        return left.join(right, shared, how)
    # rows in which the variable is bound join on it; the others take its value from the right
    c, rest = loose[0], nullable - {loose[0]}
    bound = _join(left.filter(F.col(c).isNotNull()), right, how, rest)
    unbound = _join(left.filter(F.col(c).isNull()).drop(c), right, how, rest)
    return bound.unionByName(unbound)


class Compiler:
    """Compiles queries over a frame of triples (s, p, o).

    With ``compat``, filters follow the literal behaviour of an engine that
    matches filter text by patterns: ``!BOUND`` acts as ``BOUND``, comparisons of
    unbound variables and expressions it cannot read keep the row, numbers are
    integers, and FILTER inside OPTIONAL is dropped. Without it, SPARQL's
    meaning holds: an error in a filter drops the row.
    """

    def __init__(self, triples: DataFrame, counts: Mapping[str, int] | None = None, compat: bool = False):
        self.triples, self.counts, self.compat = triples, counts, compat

    def group(self, g: Group) -> tuple[DataFrame, set[str]]:
        """Bindings of a group, and the variables that may be unbound in them."""
        out = None
        for p in order(g.patterns, self.counts):
            right = scan(self.triples, p)
            out = right if out is None else _join(out, right, "inner", set())
        if out is None:
            out = self.triples.sparkSession.range(1).select(F.lit(1).alias("\x00"))
        nullable: set[str] = set()
        for o in g.optionals:
            right, inner = self.group(Group(o.patterns, o.optionals, () if self.compat else o.filters))
            out = _join(out, right, "left", nullable)
            nullable |= (inner | set(o.variables)) - {v for p in g.patterns for v in p.variables}
        for f in g.filters:
            out = out.filter(F.coalesce(self.condition(f, set(out.columns)), F.lit(self.compat)))
        return out, nullable

    # expressions

    def value(self, e, names: set[str]) -> Column:
        if isinstance(e, Var):
            return F.col(f"`{e.name}`") if e.name in names else F.lit(None).cast("string")
        if isinstance(e, Const):
            return F.lit(e.value)
        if isinstance(e, Call):
            if e.op == "STR":
                return self.value(e.args[0], names)
            if e.op in ("LCASE", "UCASE"):
                return (F.lower if e.op == "LCASE" else F.upper)(self.value(e.args[0], names))
            if e.op == "STRLEN":
                return F.length(self.value(e.args[0], names)).cast("string")
            return self.condition(e, names)
        return F.lit(str(e))

    def condition(self, e, names: set[str]) -> Column:
        if not isinstance(e, Call):
            return self.value(e, names) == F.lit("true")
        if e.op == "!":
            inner = e.args[0]
            if self.compat and isinstance(inner, Call) and inner.op == "BOUND":
                return self.condition(inner, names)
            return ~self.condition(inner, names)
        if e.op in ("&&", "||"):
            a, b = (self.condition(x, names) for x in e.args)
            return a & b if e.op == "&&" else a | b
        if e.op == "BOUND":
            return self.value(e.args[0], names).isNotNull()
        if e.op in ("ISIRI", "ISLITERAL"):
            is_iri = self.value(e.args[0], names).rlike(r"^(\w[\w+.-]*://|urn:|[A-Za-z][\w-]*:[^\s/]+$)")
            return is_iri if e.op == "ISIRI" else ~is_iri
        if e.op in ("CONTAINS", "STRSTARTS", "STRENDS"):
            a, b = (self.value(x, names) for x in e.args)
            return {"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[e.op](a, b)
        if e.op == "REGEX":
            if not isinstance(e.args[1], Const):
                raise SparqlError("REGEX needs a literal pattern")
            flags = "".join(sorted(set(e.args[2].value) & set("ims"))) if len(e.args) > 2 else ""
            pattern = e.args[1].value.replace("(?P<", "(?<")
            return self.value(e.args[0], names).rlike((f"(?{flags})" if flags else "") + pattern)
        if e.op in ("=", "!=", "<", "<=", ">", ">="):
            a, b = e.args
            numeric = [x for x in e.args if isinstance(x, (int, float))]
            if numeric:
                if self.compat:
                    side = lambda x: F.lit(int(x)) if isinstance(x, (int, float)) else F.when(self.value(x, names).rlike(r"^[+-]?\d+$"), self.value(x, names).try_cast("bigint"))
                else:
                    side = lambda x: F.lit(float(x)) if isinstance(x, (int, float)) else number(self.value(x, names).cast("string"))
                x, y = side(a), side(b)
            else:
                x, y = self.value(a, names), self.value(b, names)
                if e.op not in ("=", "!="):  # numbers where both are, else text
                    nx, ny = number(x), number(y)
                    both = nx.isNotNull() & ny.isNotNull()
                    return F.when(both, _compare(e.op, nx, ny)).otherwise(_compare(e.op, x, y))
            return _compare(e.op, x, y)
        raise SparqlError(f"{e.op} is no condition")

    # query forms

    def aggregate(self, a: Aggregate) -> Column:
        if a.variable is None:
            return F.count(F.lit(1))
        v = F.col(f"`{a.variable}`")
        filled = F.when(v != "", v)
        if a.function == "COUNT":
            return F.countDistinct(filled) if a.distinct else F.count(filled)
        n = number(v)
        if a.function in ("SUM", "AVG"):
            once = a.distinct and not self.compat
            total = F.sum_distinct(n) if once else F.sum(n)
            f = total if a.function == "SUM" else total / (F.countDistinct(n) if once else F.count(n))
            return F.coalesce(f, F.lit(0.0))
        # numbers where every value is one, else text in code-point order
        pick = F.min_by if a.function == "MIN" else F.max_by
        text = F.min if a.function == "MIN" else F.max
        return F.when(F.count(n) == F.count(filled), pick(filled, n)).otherwise(text(filled))

    def select(self, q: Query) -> DataFrame:
        """Rows of a SELECT, one column per variable; unbound is null.

        Order: ORDER BY, DISTINCT, OFFSET, LIMIT. Plain variables sort by code
        points with unbound first, aggregates by value.
        """
        rows, _ = self.group(q.where)
        if q.aggregates:
            rows, names = self._aggregated(q, rows)
            shown = [*(q.variables or ()), *(a.alias for a in q.aggregates)]
        else:
            shown = list(q.variables) if q.variables is not None else sorted(c for c in rows.columns if c != "\x00")
            for v in shown:
                if v not in rows.columns:
                    rows = rows.withColumn(v, F.lit(None).cast("string"))
        keys = []
        for k, down in q.order_by:
            name = k if isinstance(k, str) else next((a.alias for a in q.aggregates if Aggregate(a.function, a.variable, "", a.distinct) == k.args[0]), None)
            if name is None or name not in rows.columns:
                continue
            c = F.col(f"`{name}`")
            typed = name in {a.alias for a in q.aggregates}
            c = c if typed else F.coalesce(c, F.lit(""))
            keys.append(c.desc() if down else c.asc())
        if q.distinct and not (self.compat and q.aggregates):
            extra = [k for k, _ in q.order_by if isinstance(k, str) and k not in shown and k in rows.columns]
            if extra:  # the first row of each in the order asked for
                least = [(F.max if down else F.min)(F.coalesce(F.col(f"`{k}`"), F.lit(""))).alias(k) for k, down in q.order_by if k in extra]
                rows = rows.groupBy(*[f"`{c}`" for c in shown]).agg(*least)
            else:
                rows = rows.select(*[f"`{c}`" for c in shown]).distinct()
        if keys:
            rows = rows.orderBy(*keys)
        rows = rows.select(*[F.col(f"`{c}`") for c in shown])
        if q.offset:
            rows = rows.offset(q.offset)
        return rows.limit(q.limit) if q.limit else rows

    def _aggregated(self, q: Query, rows: DataFrame) -> tuple[DataFrame, set[str]]:
        hidden = []
        for e in [*q.having, *(k for k, _ in q.order_by if isinstance(k, Call))]:
            hidden += _aggregates_in(e)
        named = {a.alias: a for a in q.aggregates}
        for k, a in enumerate(hidden):
            named[f"\x02{k}"] = a
        keys = [F.coalesce(F.col(f"`{v}`"), F.lit("")).alias(v) if v in rows.columns else F.lit("").alias(v) for v in q.group_by]
        columns = [self.aggregate(a).alias(n) for n, a in named.items()]
        out = rows.groupBy(*keys).agg(*columns) if keys else rows.agg(*columns, F.count(F.lit(1)).alias("\x03")).filter(F.col("\x03") > 0)
        where = {Aggregate(a.function, a.variable, "", a.distinct): n for n, a in reversed(named.items())}

        def rewrite(e):
            if isinstance(e, Call):
                if e.op in ("COUNT", "SUM", "AVG", "MIN", "MAX"):
                    return Var(where[e.args[0]])
                return Call(e.op, tuple(map(rewrite, e.args)))
            return e

        for h in q.having:
            out = out.filter(F.coalesce(self._having(rewrite(h), set(out.columns)), F.lit(self.compat)))
        return out, set(named)

    def _having(self, e, names: set[str]) -> Column:
        if isinstance(e, Call) and e.op in ("=", "!=", "<", "<=", ">", ">="):
            side = lambda x: F.lit(float(x)) if isinstance(x, (int, float)) else F.col(f"`{x.name}`").try_cast("double") if isinstance(x, Var) else number(F.lit(x.value))
            return _compare(e.op, side(e.args[0]), side(e.args[1]))
        if isinstance(e, Call) and e.op in ("&&", "||"):
            a, b = (self._having(x, names) for x in e.args)
            return a & b if e.op == "&&" else a | b
        if isinstance(e, Call) and e.op == "!":
            return ~self._having(e.args[0], names)
        return self.condition(e, names)

    def construct(self, q: Query) -> DataFrame:
        """Distinct triples of the template over the bindings; those with an unbound part are left out."""
        rows, _ = self.group(q.where)
        names = set(rows.columns)
        made = [F.struct(*[self.value(t, names).alias(c) for c, t in zip("spo", (p.s, p.p, p.o))]) for p in q.template]
        return rows.select(F.explode(F.array(*made)).alias("t")).select("t.*").dropna().distinct()

    def describe(self, q: Query) -> DataFrame:
        """Distinct triples that have a target as subject or object."""
        fixed = [t.value for t in q.targets if isinstance(t, Const)]
        t = self.triples.select("s", "p", "o")
        parts = [t.filter(F.col("s").isin(fixed) | F.col("o").isin(fixed))] if fixed else []
        names = [v.name for v in q.targets if isinstance(v, Var)]
        if names:
            rows, _ = self.group(q.where)
            targets = rows.select(F.explode(F.array(*[F.col(f"`{n}`") for n in names])).alias("x")).dropna().distinct()
            parts += [t.join(targets, t["s"] == targets["x"], "left_semi"), t.join(targets, t["o"] == targets["x"], "left_semi")]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct()

    def run(self, query: str | Query, expand_prefixes: bool = False) -> DataFrame:
        q = parse(query) if isinstance(query, str) else query
        if expand_prefixes:
            q = q.expand_prefixes()
        if not self.compat and (wrong := q.errors()):
            raise SparqlError("; ".join(wrong))
        return {"SELECT": self.select, "CONSTRUCT": self.construct, "DESCRIBE": self.describe}[q.form](q)


def _compare(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _aggregates_in(e) -> list[Aggregate]:
    if isinstance(e, Call):
        return [e.args[0]] if e.op in ("COUNT", "SUM", "AVG", "MIN", "MAX") else [a for x in e.args for a in _aggregates_in(x)]
    return []
