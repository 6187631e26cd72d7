"""Triples (s, p, o) and a subset of SPARQL, compiled to joins.

PREFIX; SELECT [DISTINCT] variables and (COUNT|SUM|AVG|MIN|MAX(?v) AS ?n), ASK, CONSTRUCT, DESCRIBE; WHERE with triple patterns, FILTER
(comparisons, regex, bound, && || !), OPTIONAL, UNION, and triple patterns with `a` for type; GROUP BY, HAVING, ORDER BY,
LIMIT, OFFSET. INSERT DATA and DELETE DATA change the set of triples.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.match import product

_TOKEN = re.compile(r'\s*("(?:[^"\\]|\\.)*"|<[^>\s]*>|\?\w+|&&|\|\||!=|<=|>=|[{}().;,=<>!*]|[\w:.+-]*[\w:+-]|\S)')


class Literal(str):
    """A term that is no variable, whatever it begins with."""


def variable(t: str) -> bool:
    return t.startswith("?") and not isinstance(t, Literal)


def query_triples(triples: DataFrame, s=None, p=None, o=None) -> DataFrame:
    """Triples with the terms that are given: each of the eight shapes is a filter."""
    for c, v in (("s", s), ("p", p), ("o", o)):
        triples = triples if v is None else triples.filter(F.col(c) == v)
    return triples


def distinct_terms(triples: DataFrame, column: str, **bound) -> DataFrame:
    return query_triples(triples, **bound).select(column).distinct()


def add_triples(triples: DataFrame, more: DataFrame) -> DataFrame:
    return triples.unionByName(more.select(*triples.columns)).distinct()


def remove_triples(triples: DataFrame, gone: DataFrame) -> DataFrame:
    return triples.join(gone.select("s", "p", "o"), ["s", "p", "o"], "left_anti")


def pattern(triples: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """Bindings of one pattern; terms that begin with ? are variables, one that is repeated must agree."""
    terms, where, out = {"s": s, "p": p, "o": o}, [], {}
    for c, t in terms.items():
        if not variable(t):
            where.append(F.col(c) == t)
        elif t[1:] in out:
            where.append(F.col(c) == F.col(out[t[1:]]))
        else:
            out[t[1:]] = c
    found = triples.filter(reduce(lambda a, b: a & b, where)) if where else triples
    return found.select(*[F.col(c).alias(v) for v, c in out.items()]) if out else found.select(F.lit(1).alias("_")).limit(1)


def join(a: DataFrame | None, b: DataFrame) -> DataFrame:
    if a is None:
        return b
    shared = [c for c in a.columns if c in b.columns]
    return a.join(b, shared) if shared else product(a, b)


def optional_join(a: DataFrame | None, b: DataFrame, conditions: list) -> DataFrame:
    """a with what fits of b, nulls where nothing does. Conditions may name variables of both and belong to the join."""
    if a is None:
        return reduce(DataFrame.filter, [_condition(c) for c in conditions], b)
    shared = [c for c in a.columns if c in b.columns]
    b = b.withColumnsRenamed({c: f"_{c}" for c in shared})
    if not shared and not conditions:
        return product(a, b, "left")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c in shared else F.lit(True) for c in shared] + [_condition(c) for c in conditions]
    return a.join(b, reduce(lambda x, y: x & y, on), "left").drop(*[f"_{c}" for c in shared])


def selectivity(t: tuple[str, str, str]) -> int:
    """How few rows a pattern is thought to have: bound subjects count most, then objects, then predicates."""
    s, p, o = (not variable(x) for x in t)
    return 4 * s + 3 * o + p


def join_order(patterns: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """The most selective first, then always one that shares a variable with those before it, if there is one."""
    left, out, seen = list(patterns), [], set()
    variables = lambda t: {x for x in t if variable(x)}
    while left:
        near = [t for t in left if variables(t) & seen] or left
        best = max(near, key=selectivity)
        out.append(best)
        left.remove(best)
        seen |= variables(best)
    return out


def basic_graph(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    out = None
    for t in join_order(patterns):
        out = join(out, pattern(triples, *t))
    return out


@dataclass
class Group:
    """What stands between braces."""

    patterns: list[tuple[str, str, str]] = field(default_factory=list)
    filters: list = field(default_factory=list)
    optional: list[Group] = field(default_factory=list)
    unions: list[list[Group]] = field(default_factory=list)


@dataclass
class Query:
    kind: str = "SELECT"
    distinct: bool = False
    variables: list = field(default_factory=list)
    template: list[tuple[str, str, str]] = field(default_factory=list)
    where: Group = field(default_factory=Group)
    group_by: list[str] = field(default_factory=list)
    having: object = None
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


class _Parser:
    def __init__(self, text: str):
        self.tokens = [t for t in _TOKEN.findall(text) if t]
        self.at = 0
        self.prefixes: dict[str, str] = {}

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def word(self) -> str:
        return self.peek().upper()

    def next(self) -> str:
        t = self.peek()
        if not t:
            raise ValueError("the query ends too early")
        self.at += 1
        return t

    def take(self, *words: str) -> bool:
        if self.word() in words:
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise ValueError(f"{word} is missing before {self.peek()!r}")

    def term(self) -> str:
        return self.constant(self.next())

    def constant(self, t: str) -> str:
        """A term as it is in triples: literals and names without their marks, prefixes spelled out."""
        if t == "a":
            return "type"
        if t[0] == '"':
            return Literal(re.sub(r"\\(.)", r"\1", t[1:-1]))
        if t[0] == "<":
            return Literal(t[1:-1])
        head, colon, rest = t.partition(":")
        return self.prefixes[head] + rest if colon and head in self.prefixes else t

    def triples(self) -> list[tuple[str, str, str]]:
        out, s = [], self.term()
        while True:
            p = self.term()
            while True:
                out.append((s, p, self.term()))
                if not self.take(","):
                    break
            if not self.take(";"):
                break
        self.take(".")
        return out

    def group(self) -> Group:
        self.need("{")
        g = Group()
        while not self.take("}"):
            if self.take("FILTER"):
                g.filters.append(self.condition())
            elif self.take("OPTIONAL"):
                g.optional.append(self.group())
            elif self.peek() == "{":
                parts = [self.group()]
                while self.take("UNION"):
                    parts.append(self.group())
                g.unions.append(parts)
            elif self.take("."):
                pass
            else:
                g.patterns += self.triples()
        return g

    def condition(self):
        left = self.conjunction()
        while self.take("||"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.atom()
        while self.take("&&"):
            left = ("and", left, self.atom())
        return left

    def atom(self):
        if self.take("!"):
            return ("not", self.atom())
        if self.word() in ("REGEX", "CONTAINS", "BOUND"):
            name = self.next().upper()
            self.need("(")
            args = [self.next()]
            while self.take(","):
                args.append(self.next())
            self.need(")")
            return (name.lower(), *args)
        if self.take("("):
            inner = self.condition()
            self.need(")")
            return inner
        if self.word() in ("COUNT", "SUM", "AVG", "MIN", "MAX"):
            left = self.aggregate()
        else:
            left = self.operand()
        if self.peek() in ("=", "!=", "<", ">", "<=", ">="):
            return ("compare", left, self.next(), self.operand())
        return left

    def operand(self) -> str:
        """A variable, number or literal as it stands, or a name with its prefix spelled out, as a literal."""
        t = self.next()
        return f'"{self.constant(t)}"' if ":" in t and t[0] not in '"<?' and t.split(":")[0] in self.prefixes else t

    def aggregate(self):
        name = self.next().upper()
        self.need("(")
        distinct = self.take("DISTINCT")
        v = self.next()
        self.need(")")
        return ("aggregate", name, distinct, v)

    def query(self) -> Query:
        q = Query()
        while self.take("PREFIX"):
            name = self.next()
            self.prefixes[name.rstrip(":")] = self.next().strip("<>")
        q.kind = self.next().upper()
        if q.kind == "SELECT":
            q.distinct = self.take("DISTINCT")
            while self.word() not in ("WHERE", "{"):
                if self.take("("):
                    made = self.aggregate()
                    self.need("AS")
                    q.variables.append((made, self.next()[1:]))
                    self.need(")")
                else:
                    q.variables.append(self.next())
        elif q.kind == "CONSTRUCT":
            q.template = self.group().patterns
        elif q.kind in ("INSERT", "DELETE"):
            self.need("DATA")
            q.template = self.group().patterns
            return q
        elif q.kind == "DESCRIBE":
            while self.peek() and self.word() not in ("WHERE", "{"):
                q.variables.append(self.term())
            if not self.peek():
                return q
        elif q.kind != "ASK":
            raise ValueError(f"not a query: {q.kind}")
        self.take("WHERE")
        q.where = self.group()
        while self.peek():
            if self.take("GROUP"):
                self.need("BY")
                while self.peek().startswith("?"):
                    q.group_by.append(self.next()[1:])
            elif self.take("HAVING"):
                self.need("(")
                q.having = self.condition()
                self.need(")")
            elif self.take("ORDER"):
                self.need("BY")
                while self.peek().startswith("?") or self.word() in ("ASC", "DESC"):
                    if self.word() in ("ASC", "DESC"):
                        down = self.next().upper() == "DESC"
                        self.need("(")
                        q.order.append((self.next()[1:], down))
                        self.need(")")
                    else:
                        q.order.append((self.next()[1:], False))
            elif self.take("LIMIT"):
                q.limit = int(self.next())
            elif self.take("OFFSET"):
                q.offset = int(self.next())
            else:
                raise ValueError(f"not understood: {self.peek()!r}")
        return q


def parse(text: str) -> Query:
    return _Parser(text).query()


def _value(t) -> Column:
    if isinstance(t, tuple):
        return _aggregate(t)
    if t.startswith("?"):
        return F.col(t[1:])
    if t[0] in '"<':
        return F.lit(t[1:-1])
    return F.lit(float(t)) if re.fullmatch(r"[+-]?\d+(\.\d+)?", t) else F.lit(t)


def _aggregate(t: tuple) -> Column:
    _, name, distinct, v = t
    if name == "COUNT":
        if v == "*":
            return F.count("*")
        return F.countDistinct(v[1:]) if distinct else F.count(v[1:])
    return {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[name](F.col(v[1:]).cast("double"))


def _condition(c) -> Column:
    if not isinstance(c, tuple):
        return _value(c).cast("boolean")
    kind = c[0]
    if kind in ("and", "or"):
        a, b = _condition(c[1]), _condition(c[2])
        return a & b if kind == "and" else a | b
    if kind == "not":
        return ~_condition(c[1])
    if kind == "bound":
        return F.col(c[1][1:]).isNotNull()
    if kind == "regex":
        flags = "(?i)" if len(c) > 3 and "i" in c[3] else ""
        return _value(c[1]).rlike(flags + c[2][1:-1])
    if kind == "contains":
        return F.contains(_value(c[1]), _value(c[2]))
    _, left, op, right = c
    a, b = _value(left), _value(right)
    numeric = any(isinstance(x, str) and re.fullmatch(r"[+-]?\d+(\.\d+)?", x) for x in (left, right)) or op in ("<", ">", "<=", ">=") and not any(isinstance(x, str) and x[0] == '"' for x in (left, right))
    if numeric:
        a, b = a.try_cast("double"), b.try_cast("double")
    return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def evaluate(triples: DataFrame, g: Group) -> DataFrame:
    out = basic_graph(triples, g.patterns) if g.patterns else None
    for parts in g.unions:
        out = join(out, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [evaluate(triples, p) for p in parts]))
    for o in g.optional:
        out = optional_join(out, evaluate(triples, Group(o.patterns, [], o.optional, o.unions)), o.filters)
    for c in g.filters:
        out = out.filter(_condition(c))
    return out


def sparql(triples: DataFrame, text: str) -> DataFrame:
    """Rows of a SELECT, (result) of an ASK, triples of a CONSTRUCT, or all triples after INSERT DATA or DELETE DATA."""
    q = parse(text)
    if q.kind in ("INSERT", "DELETE"):
        given = triples.sparkSession.createDataFrame(q.template, "s string, p string, o string")
        return (add_triples if q.kind == "INSERT" else remove_triples)(triples.select("s", "p", "o"), given)
    if q.kind == "DESCRIBE":
        return describe(triples, q)
    out = evaluate(triples, q.where)
    if q.kind == "ASK":
        return out.limit(1).agg((F.count("*") > 0).alias("result"))
    if q.kind == "CONSTRUCT":
        term = lambda t: F.col(t[1:]) if variable(t) else F.lit(str(t))
        made = F.explode(F.array(*[F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o")) for s, p, o in q.template]))
        return out.select(made.alias("t")).select("t.*").filter("s is not null and p is not null and o is not null").distinct()
    named = [v for v in q.variables if isinstance(v, tuple)]
    if q.group_by or named:
        having = []
        if q.having is not None:
            having = [_condition(q.having).alias("_having")]
        out = out.groupBy(*q.group_by).agg(*[_aggregate(a).alias(n) for a, n in named], *having)
        out = out.filter("_having") if having else out
    names = out.columns if q.variables == ["*"] else [v[1] if isinstance(v, tuple) else v[1:] for v in q.variables]
    names = [n for n in names if n != "_having"]
    extra = [v for v, _ in q.order if v not in names]
    if q.distinct:  # before the order; what is ordered by but not shown counts with its least value
        out = out.groupBy(*names).agg(*[F.min(v).alias(v) for v in extra]) if extra else out.select(*names).distinct()
    if q.order:
        out = out.orderBy(*[F.desc(v) if down else F.asc(v) for v, down in q.order])
    out = out.select(*names)
    out = out.offset(q.offset) if q.offset else out
    return out if q.limit is None else out.limit(q.limit)


def describe(triples: DataFrame, q: Query) -> DataFrame:
    """All triples of which a named resource, or one that a variable is bound to, is the subject or the object."""
    spark = triples.sparkSession
    named = [str(t) for t in q.variables if not variable(t)]
    found = spark.createDataFrame([(t,) for t in named], "r string")
    if any(variable(t) for t in q.variables):
        rows = evaluate(triples, q.where)
        for t in q.variables:
            found = found.unionByName(rows.select(F.col(t[1:]).alias("r"))) if variable(t) else found
    found = found.filter("r is not null").distinct()
    t = triples.select("s", "p", "o")
    return t.join(found.withColumnRenamed("r", "s"), "s", "left_semi").select("s", "p", "o").unionByName(t.join(found.withColumnRenamed("r", "o"), "o", "left_semi").select("s", "p", "o")).distinct()


def batch(triples: DataFrame, texts: list[str]) -> list[DataFrame]:
    """The results of many queries; a change holds for those after it."""
    out = []
    for text in texts:
        out.append(sparql(triples, text))
        triples = out[-1] if parse(text).kind in ("INSERT", "DELETE") else triples
    return out


def explain(text: str) -> dict:
    """Kind, patterns in join order with how they join, those of unions and optional parts after them, filters and an estimated cost."""
    q = parse(text)
    steps, seen, cost = [], set(), 1.0

    def walk(g: Group, kind: str) -> None:
        nonlocal seen, cost
        for t in join_order(g.patterns):
            v = {x for x in t if variable(x)}
            how = "scan" if not steps else "hash_join" if v & seen else "cross_product"
            cost += 1000 / 10 ** (selectivity(t) / 3) * (100 if how == "cross_product" else 1)
            steps.append({"pattern": t, "how": how, "variables": sorted(v), "part": kind})
            seen |= v
        for parts in g.unions:
            for x in parts:
                walk(x, "union")
        for x in g.optional:
            walk(x, "optional")

    walk(q.where, "where")
    return {"kind": q.kind, "steps": steps, "filters": len(q.where.filters), "optional": len(q.where.optional), "cost": round(cost, 3)}


def closure(edges: DataFrame) -> DataFrame:
    """(a, b) pairs that a chain of (a, b) reaches; each round doubles the length."""
    from weft.plans.lineage import table

    seen, n = table(edges.select("a", "b").distinct(), "closure"), -1
    while (size := seen.count()) != n:
        n = size
        step = seen.join(seen.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        seen = table(seen.unionByName(step).distinct(), "closure")
    return seen


#: What follows from the schema's triples, as rules over t(subject, predicate, object).
RDFS = """
    t(X, subClassOf, Z) :- t(X, subClassOf, Y), t(Y, subClassOf, Z).
    t(X, subPropertyOf, Z) :- t(X, subPropertyOf, Y), t(Y, subPropertyOf, Z).
    t(X, type, Z) :- t(Y, subClassOf, Z), t(X, type, Y).
    t(X, Q, Y) :- t(P, subPropertyOf, Q), t(X, P, Y).
    t(X, type, C) :- t(P, domain, C), t(X, P, _).
    t(Y, type, C) :- t(P, range, C), t(_, P, Y).
    t(Y, Q, X) :- t(P, inverseOf, Q), t(X, P, Y).
    t(X, P, Z) :- t(P, type, "TransitiveProperty"), t(X, P, Y), t(Y, P, Z).
"""


def rdfs(triples: DataFrame, rules: str = "") -> DataFrame:
    """The triples and what follows from subClassOf, subPropertyOf, domain, range, inverseOf and transitive properties, and from
    further rules over t; each round only from what the round before has found."""
    from weft.plans.datalog import Program

    found = Program(triples.sparkSession, {"t": triples.select("s", "p", "o")}).add(RDFS + rules).query("t(S, P, O)")
    return found.select(F.col("S").alias("s"), F.col("P").alias("p"), F.col("O").alias("o"))


def shape_violations(triples: DataFrame, target: str, properties: dict[str, dict]) -> DataFrame:
    """(s, p, rule): instances of a class that break a shape: properties by name with min, max (values a subject), pattern, one_of, kind (of the object)."""
    t = triples.select("s", "p", "o")
    nodes = query_triples(t, p="type", o=target).select("s").distinct()
    out = []
    for name, shape in properties.items():
        own = nodes.join(query_triples(t, p=name).select("s", "o").distinct(), "s", "left")
        n = F.count("o")
        per = own.groupBy("s").agg(n.alias("n"))
        broken = lambda rows, rule, name=name: rows.select("s", F.lit(name).alias("p"), F.lit(rule).alias("rule"))
        if "min" in shape:
            out.append(broken(per.filter(F.col("n") < shape["min"]), "min"))
        if "max" in shape:
            out.append(broken(per.filter(F.col("n") > shape["max"]), "max"))
        if "pattern" in shape:
            out.append(broken(own.filter(~F.col("o").rlike(shape["pattern"])).select("s").distinct(), "pattern"))
        if "one_of" in shape:
            out.append(broken(own.filter(~F.col("o").isin(shape["one_of"])).select("s").distinct(), "one_of"))
        if "kind" in shape:
            of = query_triples(t, p="type", o=shape["kind"]).select(F.col("s").alias("o"))
            out.append(broken(own.filter("o is not null").join(of, "o", "left_anti").select("s").distinct(), "kind"))
    return reduce(DataFrame.unionByName, out)


def in_context(facts: DataFrame, context: str, column: str = "context", default: str = "default") -> DataFrame:
    """Facts of a context and of the default one."""
    return facts.filter(F.col(column).isin(context, default))
