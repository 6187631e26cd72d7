"""Datalog over DataFrames: rules are compiled to joins, strata are found, and fixpoints run on what is new.

    ancestor(X, Y) :- parent(X, Y).
    ancestor(X, Z) :- ancestor(X, Y), parent(Y, Z).
    lonely(X) :- person(X), not friend(X, _), X != "Bob".

Variables begin with a capital or _; each _ is a variable of its own; everything else is a constant. Besides atoms a body
has negated atoms (not p(...)) and comparisons (= != < > <= >=; < and the like compare numbers). Facts are sets: relations
are DataFrames of string columns _0, _1, ... without repeated rows.

    next(X, N) :- at(X, M), N = M + 1.
    team_size(C, N) :- company(C), N = count(X : works_at(X, C)).
    team(C, T) :- company(C), T = {X : works_at(X, C), expert(X)}.
    best(C, T) :- company(C), T = top(2, X, S : score(C, X, S)).

N = M + 1 (also - * /, parted by spaces) gives a new variable a value. count, sum, min, max, avg, top and {...} are taken over
the different values, for what the goals after the colon share with the rest of the rule; a group without any has count
0, an empty set, and no row else. Sets and the best are written with commas. What is aggregated is derived before, as what
is negated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators.match import product
from weft.plans.lineage import table

_TOKEN = re.compile(r'\s*(?:%[^\n]*\n?)?\s*(:-|!=|<=|>=|"(?:[^"\\]|\\.)*"|\'[^\']*\'|-?\d+\.\d+|[(),.=<>{}:]|[\w-]+|\S)')
_COMPARE = ("=", "!=", "<", ">", "<=", ">=")
AGGREGATES = ("count", "sum", "min", "max", "avg", "top")


@dataclass(frozen=True)
class Atom:
    name: str
    terms: tuple[str, ...]
    negated: bool = False

    @property
    def variables(self) -> set[str]:
        return {t for t in self.terms if is_variable(t)}


@dataclass(frozen=True)
class Comparison:
    left: str
    op: str
    right: str

    @property
    def variables(self) -> set[str]:
        return {t for t in (self.left, self.right) if is_variable(t)}


@dataclass(frozen=True)
class Arithmetic:
    """left = terms joined by operators; a new variable on the left gets the value."""

    left: str
    terms: tuple[str, ...]

    @property
    def variables(self) -> set[str]:
        return {t for t in (self.left, *self.terms) if is_variable(t)}


@dataclass(frozen=True)
class Aggregate:
    """left = kind(values : goals)."""

    left: str
    kind: str
    values: tuple[str, ...]
    goals: tuple
    most: int = 0

    @property
    def inner(self) -> set[str]:
        return set().union(*[g.variables for g in self.goals])

    @property
    def variables(self) -> set[str]:
        return ({self.left} if is_variable(self.left) else set()) | self.inner


@dataclass
class Rule:
    head: Atom
    body: list = field(default_factory=list)


def is_variable(t: str) -> bool:
    return t[:1] == "_" or t[:1].isupper()


def _constant(t: str) -> str:
    return t[1:-1] if t[:1] in "\"'" else t


def parse(text: str) -> list[Rule]:
    """Rules, and facts as rules without a body."""
    tokens, at, fresh = [t for t in _TOKEN.findall(text) if t], 0, 0

    def take(expected: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens) or (expected is not None and tokens[at] != expected):
            raise ValueError(f"{expected or 'more'} is missing at {' '.join(tokens[at : at + 4])!r}")
        at += 1
        return tokens[at - 1]

    def term() -> str:
        nonlocal fresh
        t = take()
        if t == "_":
            fresh += 1
            return f"_{fresh}_"
        return t

    def aggregate(left: str, kind: str, end: str) -> Aggregate:
        values = [term()]
        while tokens[at] == ",":
            take()
            values.append(term())
        take(":")
        goals = [literal()]
        while tokens[at] == ",":
            take()
            goals.append(literal())
        take(end)
        most = int(values.pop(0)) if kind == "top" else 0
        return Aggregate(left, kind, tuple(values), tuple(goals), most)

    def literal():
        nonlocal at
        negated = tokens[at] == "not"
        at += negated
        name = term()
        if at < len(tokens) and tokens[at] in _COMPARE:
            op = take()
            if op == "=" and tokens[at : at + 1] == ["{"]:
                take()
                return aggregate(name, "set", "}")
            if op == "=" and tokens[at] in AGGREGATES and tokens[at + 1 : at + 2] == ["("]:
                kind = take()
                take("(")
                return aggregate(name, kind, ")")
            right = [term()]
            while tokens[at : at + 1] and tokens[at] in ("+", "-", "*", "/"):
                right += [take(), term()]
            return Arithmetic(name, tuple(right)) if len(right) > 1 else Comparison(name, op, right[0])
        take("(")
        terms = []
        if tokens[at] != ")":
            terms.append(term())
            while tokens[at] == ",":
                take()
                terms.append(term())
        take(")")
        return Atom(name, tuple(terms), negated)

    out = []
    while at < len(tokens):
        head = literal()
        body = []
        if at < len(tokens) and tokens[at] == ":-":
            take()
            body.append(literal())
            while tokens[at : at + 1] == [","]:
                take()
                body.append(literal())
        take(".")
        out.append(Rule(head, body))
    return out


def check_safe(rule: Rule) -> None:
    """Variables of the head, of negated atoms (but _) and of comparisons must be in a positive atom, or get a value before."""
    bound = set().union(*[a.variables for a in rule.body if isinstance(a, Atom) and not a.negated], set())
    for part in rule.body:
        if isinstance(part, Arithmetic):
            if {t for t in part.terms if is_variable(t)} - bound:
                raise ValueError(f"unsafe: {part}")
            bound |= part.variables
        elif isinstance(part, Aggregate):
            if set(part.values) - part.inner:
                raise ValueError(f"unsafe: {part}")
            bound.add(part.left)
    for part in [rule.head, *rule.body]:
        if isinstance(part, (Arithmetic, Aggregate)):
            continue
        loose = {v for v in part.variables - bound if not (isinstance(part, Atom) and part.negated and re.fullmatch(r"_\d+_", v))}
        if (part is rule.head or isinstance(part, Comparison) or part.negated) and loose:
            raise ValueError(f"unsafe: {', '.join(sorted(loose))} in {part}")


def needs(rule: Rule) -> list[tuple[str, bool]]:
    """Predicates that a rule depends on, and whether these must be whole before: negated and aggregated ones."""
    own = [(a.name, a.negated) for a in rule.body if isinstance(a, Atom)]
    return own + [(a.name, True) for x in rule.body if isinstance(x, Aggregate) for a in x.goals if isinstance(a, Atom)]


def strata(rules: list[Rule]) -> list[set[str]]:
    """Predicates by stratum; a predicate that depends on its own negation has none."""
    level = {r.head.name: 0 for r in rules}
    for _ in range(len(level) + 1):
        changed = False
        for r in rules:
            for name, whole in needs(r):
                if name in level:
                    least = level[name] + whole
                    if level[r.head.name] < least:
                        level[r.head.name], changed = least, True
        if not changed:
            break
    else:
        raise ValueError("a predicate depends on its own negation")
    return [{n for n, k in level.items() if k == at} for at in sorted(set(level.values()))]


def bindings(relation: DataFrame, atom: Atom) -> DataFrame:
    """A column for each variable of an atom; constants and repeated variables are filters."""
    columns: dict[str, str] = {}
    for i, t in enumerate(atom.terms):
        if not is_variable(t):
            relation = relation.filter(F.col(f"_{i}") == _constant(t))
        elif t in columns:
            relation = relation.filter(F.col(f"_{i}") == F.col(columns[t]))
        else:
            columns[t] = f"_{i}"
    return relation.select(*[F.col(c).alias(v) for v, c in columns.items()]) if columns else relation.select(F.lit("").alias("_none")).limit(1)


def _operand(t: str, numeric: bool):
    c = F.col(t) if is_variable(t) else F.lit(_constant(t))
    return c.try_cast("double") if numeric else c


def _number(c):
    """A number as text, a whole one without a fraction."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def _joined(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    shared = [c for c in a.columns if c in b.columns]
    return a.join(b, shared, how) if shared else product(a, b, how)


def _computed(out: DataFrame, part: Arithmetic) -> DataFrame:
    value = _operand(part.terms[0], True)
    for op, t in zip(part.terms[1::2], part.terms[2::2], strict=True):
        x = _operand(t, True)
        value = value + x if op == "+" else value - x if op == "-" else value * x if op == "*" else value / F.nullif(x, F.lit(0.0))
    if is_variable(part.left) and part.left not in out.columns:
        return out.withColumn(part.left, _number(value)).filter(F.col(part.left).isNotNull())
    return out.filter(_operand(part.left, True) == value)


def _aggregated(out: DataFrame, part: Aggregate, relation) -> DataFrame:
    """Left join of the goals' aggregate, by what they share with the rest of the rule."""
    by = sorted(part.inner & set(out.columns) - set(part.values))
    columns = list(dict.fromkeys([*by, *part.values]))
    goal = Rule(Atom("_", tuple(columns)), list(part.goals))
    rows = evaluate(goal, lambda a, _: relation(a, -1)).toDF(*columns)
    x = F.col(part.values[0])
    if part.kind == "top":
        score = F.col(part.values[1]).try_cast("double")
        nth = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc(score), x))
        rows = rows.withColumn("_nth", nth).filter(F.col("_nth") <= part.most)
        made = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_nth", x.alias("v")))), lambda s: s["v"]), ",")
    elif part.kind == "set":
        made = F.array_join(F.sort_array(F.collect_set(x)), ",")
    elif part.kind == "count":
        made = F.count("*").cast("string")
    else:
        made = _number({"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[part.kind](x.try_cast("double")))
    found = rows.groupBy(*by).agg(made.alias("_made"))
    out = _joined(out, found, "left")
    if part.kind in ("count", "set"):
        out = out.withColumn("_made", F.coalesce("_made", F.lit("0" if part.kind == "count" else "")))
    out = out.filter("_made is not null")
    if is_variable(part.left) and part.left not in out.columns:
        return out.withColumnRenamed("_made", part.left)
    return out.filter(F.col("_made") == _operand(part.left, False)).drop("_made")


def evaluate(rule: Rule, relation) -> DataFrame:
    """The head's rows; relation(atom, place in the body) gives each atom's relation."""
    out = None
    positive = [(i, a) for i, a in enumerate(rule.body) if isinstance(a, Atom) and not a.negated]
    while positive:  # always an atom that shares a variable, if there is one
        near = [x for x in positive if out is None or x[1].variables & set(out.columns)] or positive
        i, a = near[0]
        positive.remove((i, a))
        found = bindings(relation(a, i), a)
        out = found if out is None else _joined(out, found)
        used = set().union(rule.head.variables, *[p.variables for p in rule.body if not isinstance(p, Atom) or p.negated], *[p.variables for _, p in positive], set())
        kept = [c for c in out.columns if c in used]
        if kept and len(kept) < len(out.columns):
            out = out.select(*kept).distinct()  # what is projected away only had to exist
    for i, a in enumerate(rule.body):
        if isinstance(a, Aggregate):
            out = _aggregated(out, a, relation)
        elif isinstance(a, Arithmetic):
            out = _computed(out, a)
        elif isinstance(a, Comparison):
            numeric = a.op not in ("=", "!=")
            x, y = _operand(a.left, numeric), _operand(a.right, numeric)
            out = out.filter({"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[a.op])
        elif a.negated:
            found = bindings(relation(a, i), a)
            shared = [c for c in found.columns if c in out.columns]
            out = out.join(found.select(*shared).distinct(), shared, "left_anti") if shared else (out if found.isEmpty() else out.limit(0))
    return out.select(*[(F.col(t) if is_variable(t) else F.lit(_constant(t))).alias(f"_{i}") for i, t in enumerate(rule.head.terms)]).distinct()


class Program:
    """Relations and rules; run() derives all that follows, query() asks."""

    def __init__(self, spark: SparkSession, facts: dict[str, DataFrame] | None = None, max_rounds: int = 1000):
        self.spark, self.max_rounds = spark, max_rounds
        self.relations = {n: self._named(df) for n, df in (facts or {}).items()}
        self.rules: list[Rule] = []
        self.given: dict[str, DataFrame] = {}
        self.derived = False

    @staticmethod
    def _named(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(df.columns)]).distinct()

    def add(self, text: str) -> Program:
        """Adds rules and facts as text."""
        given: dict[str, list[tuple]] = {}
        for r in parse(text):
            if r.body:
                check_safe(r)
                self.rules.append(r)
            elif r.head.variables:
                raise ValueError(f"a fact with variables: {r.head}")
            else:
                given.setdefault(r.head.name, []).append(tuple(_constant(t) for t in r.head.terms))
        for name, rows in given.items():
            self.add_facts(name, self.spark.createDataFrame(rows, ", ".join(f"_{i} string" for i in range(len(rows[0])))))
        self.derived = False
        return self

    def add_facts(self, name: str, df: DataFrame) -> Program:
        df = self._named(df)
        self.relations[name] = self.relations[name].unionByName(df).distinct() if name in self.relations else df
        self.derived = False
        return self

    def _empty(self, atom: Atom) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join(f"_{i} string" for i in range(len(atom.terms))))

    def _of(self, atom: Atom) -> DataFrame:
        return self.relations[atom.name] if atom.name in self.relations else self._empty(atom)

    def run(self) -> Program:
        self.given = dict(self.relations)
        for stratum in strata(self.rules):
            rules = [r for r in self.rules if r.head.name in stratum]
            recursive = any(name in stratum for r in rules for name, _ in needs(r))
            first: dict[str, DataFrame] = {}
            for r in rules:
                rows = evaluate(r, lambda a, _: self._of(a))
                name = r.head.name
                first[name] = first[name].unionByName(rows).distinct() if name in first else rows
            if not recursive:  # no loop: the plan stays whole and lazy
                for n, rows in first.items():
                    self.relations[n] = self.relations[n].unionByName(rows).distinct() if n in self.relations else rows
                continue
            delta = {}
            for n, rows in first.items():
                old = self.relations.get(n)
                delta[n] = table(rows if old is None else rows.join(old, rows.columns, "left_anti"), f"delta-{n}")
                self.relations[n] = delta[n] if old is None else table(old.unionByName(delta[n]), n)
            self._spread(rules, delta)
        self.derived = True
        return self

    def _spread(self, rules: list[Rule], delta: dict[str, DataFrame]) -> None:
        """Rounds in which one atom of a rule is taken from what is new, the rest from all, until nothing is new."""
        for _ in range(self.max_rounds):
            new: dict[str, DataFrame] = {}
            for r in rules:
                for place, a in enumerate(r.body):
                    if isinstance(a, Atom) and not a.negated and a.name in delta:
                        rows = evaluate(r, lambda b, i, place=place: delta[b.name] if i == place else self._of(b))
                        n = r.head.name
                        new[n] = new[n].unionByName(rows) if n in new else rows
            old = lambda n, rows: self.relations[n] if n in self.relations else rows.limit(0)
            delta = {n: table(rows.distinct().join(old(n, rows), rows.columns, "left_anti"), f"delta-{n}") for n, rows in new.items()}
            delta = {n: d for n, d in delta.items() if not d.isEmpty()}
            if not delta:
                return
            for n, d in delta.items():
                self.relations[n] = table(old(n, d).unionByName(d), n)
        raise RuntimeError(f"no fixpoint after {self.max_rounds} rounds")

    def extend(self, name: str, df: DataFrame) -> Program:
        """More facts after run(): only what follows from them is derived, or all again where something is negated or aggregated."""
        if not self.derived:
            return self.add_facts(name, df)
        if any(whole for r in self.rules for _, whole in needs(r)):
            self.relations = {n: x for n, x in self.given.items()}
            return self.add_facts(name, df).run()
        df = self._named(df)
        old = self.relations.get(name)
        fresh = table(df if old is None else df.join(old, df.columns, "left_anti"), f"delta-{name}")
        self.relations[name] = fresh if old is None else table(old.unionByName(fresh), name)
        self.given[name] = self.given[name].unionByName(fresh) if name in self.given else fresh
        self._spread(self.rules, {name: fresh})
        return self

    def query(self, goal: str) -> DataFrame:
        """A column for each variable of a goal such as p(X, "a")."""
        if not self.derived:
            self.run()
        atom = parse(goal.rstrip(". ") + ".")[0].head
        found = bindings(self._of(atom), atom)
        return found.select(*[c for c in found.columns if not re.fullmatch(r"_\d+_", c)]).distinct()

    def holds(self, goal: str) -> bool:
        if not self.derived:
            self.run()
        atom = parse(goal.rstrip(". ") + ".")[0].head
        return not bindings(self._of(atom), atom).isEmpty()

    def aggregate(self, name: str, by: list[int], **named) -> DataFrame:
        """Aggregates of a relation: count=None, or sum/min/max/avg/set=place of the argument."""
        if not self.derived:
            self.run()
        make = {"count": lambda _: F.count("*"), "sum": lambda c: F.sum(c.cast("double")), "min": F.min, "max": F.max, "avg": lambda c: F.avg(c.cast("double")), "set": lambda c: F.sort_array(F.collect_set(c))}
        return self.relations[name].groupBy(*[f"_{i}" for i in by]).agg(*[make[k](None if v is None else F.col(f"_{v}")).alias(k) for k, v in named.items()])

    def magic(self, goal: str) -> DataFrame:
        """query() for a goal with constants, from these on: each rule is only applied where something asks for its head.

        A predicate is copied for each set of its places that are bound when it is asked for; beside each copy stands the
        relation of the values asked for, which the goal seeds and rules pass on from left to right. Where the goal depends on
        something negated or aggregated the whole is derived.
        """
        atom = parse(goal.rstrip(". ") + ".")[0].head
        derived = {r.head.name for r in self.rules}
        if atom.name not in derived or any(whole for r in self.rules for _, whole in needs(r)):
            return self.query(goal)
        mark = lambda terms, bound: "".join("b" if not is_variable(t) or t in bound else "f" for t in terms)
        copy = lambda a, m: Atom(f"{a.name}_{m}", a.terms)
        asked = lambda a, m: Atom(f"asked_{a.name}_{m}", tuple(t for t, x in zip(a.terms, m, strict=True) if x == "b"))
        first = mark(atom.terms, set())
        program = Program(self.spark, {n: x for n, x in (self.given if self.derived else self.relations).items()}, self.max_rounds)
        todo, done = [(atom.name, first)], set()
        while todo:
            name, m = todo.pop()
            if (name, m) in done:
                continue
            done.add((name, m))
            for r in [r for r in self.rules if r.head.name == name]:
                seed = asked(r.head, m)
                body, bound = [seed] if seed.terms else [], set(seed.variables)
                for a in r.body:
                    if isinstance(a, Atom) and a.name in derived:
                        own = mark(a.terms, bound)
                        if (ask := asked(a, own)).terms and body:
                            program.rules.append(Rule(ask, list(body)))
                        todo.append((a.name, own))
                        body.append(copy(a, own))
                    else:
                        body.append(a)
                    bound |= a.variables
                program.rules.append(Rule(copy(r.head, m), body))
        seed = asked(atom, first)
        if seed.terms:
            row = tuple(_constant(t) for t in seed.terms)
            program.relations[seed.name] = self.spark.createDataFrame([row], ", ".join(f"_{i} string" for i in range(len(row))))
        for name, m in done:  # facts of a derived predicate count as well
            if name in program.relations:
                a = Atom(name, tuple(f"V{i}" for i in range(len(m))))
                program.rules.append(Rule(copy(a, m), [a]))
        program.run()
        found = bindings(program._of(copy(atom, first)), atom)
        return found.select(*[c for c in found.columns if not re.fullmatch(r"_\d+_", c)]).distinct()

    def prove(self, goal: str, depth: int = 20) -> list[tuple[int, str, str]] | None:
        """Backward from a goal without variables: (level, fact, by), each fact with the rule or as given; None if it does not hold."""
        if not self.derived:
            self.run()
        atom = parse(goal.rstrip(". ") + ".")[0].head
        said = lambda a: f"{a.name}({', '.join(map(_constant, a.terms))})"

        def prove(a: Atom, level: int, above: tuple) -> list | None:
            if said(a) in above or level > depth or bindings(self._of(a), a).isEmpty():
                return None
            if a.name in self.given and not bindings(self.given[a.name], a).isEmpty():
                return [(level, said(a), "given")]
            for r in [r for r in self.rules if r.head.name == a.name]:
                fixed = {t: f'"{_constant(v)}"' for t, v in zip(r.head.terms, a.terms, strict=True) if is_variable(t)}
                if any(not is_variable(t) and _constant(t) != _constant(v) for t, v in zip(r.head.terms, a.terms, strict=True)):
                    continue
                put = lambda x: Atom(x.name, tuple(fixed.get(t, t) for t in x.terms), x.negated) if isinstance(x, Atom) else Comparison(fixed.get(x.left, x.left), x.op, fixed.get(x.right, x.right)) if isinstance(x, Comparison) else x  # noqa: E731,B023
                body = [put(x) for x in r.body]
                free = sorted(set().union(*[x.variables for x in body if isinstance(x, Atom) and not x.negated], set()))
                names = free or ["_none"]
                rows = evaluate(Rule(Atom("_", tuple(free) or ("yes",)), body), lambda b, _: self._of(b)).toDF(*names).orderBy(*names).limit(8).collect()
                for row in rows:
                    ground = [Atom(x.name, tuple(f'"{row[t]}"' if t in free else t for t in x.terms)) for x in body if isinstance(x, Atom) and not x.negated]
                    parts = []
                    for x in ground:
                        got = prove(x, level + 1, (*above, said(a)))
                        if got is None:
                            break
                        parts += got
                    else:
                        return [(level, said(a), f"{r.head.name}/{len(r.head.terms)}"), *parts]
            return None

        return prove(atom, 0, ())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
