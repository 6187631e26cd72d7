"""A declarative language for knowledge: definitions, assertions, relationships, rules and questions.

    DEFINE entity Person WITH PROPERTIES name AS string, age AS int END
    DEFINE relationship KNOWS CONNECTING Person TO Person END
    ASSERT Person ann WITH name "Ann", age 31
    ESTABLISH KNOWS BETWEEN ann AND bob WITH since 2001
    WHEN x KNOWS y AND y KNOWS z THEN x MAY_KNOW z
    FIND ALL Person x WHERE x.age > 30 AND x KNOWS bob DURING FROM 2000-01-01 TO 2005-01-01 ORDERED BY x.age DESC
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.predicates import compare, prop
from weft.operators.match import EdgeSpec, Pattern, match
from weft.operators.temporal import overlaps
from weft.sources.tables import Graph

_TOKEN = re.compile(r'\s*("(?:[^"\\]|\\.)*"|!=|<=|>=|[=<>,]|\d{4}-\d\d-\d\d|[\w.:-]+)')
_STATEMENT = ("DEFINE", "DECLARE", "ASSERT", "ESTABLISH", "WHEN", "FIND")


class Knowledge:
    """A graph (nodes: id, type, properties; edges: src, dst, type and, for times, valid_from, valid_to) and what is defined of it."""

    def __init__(self, graph: Graph):
        self.graph, self.spark = graph, graph.nodes.sparkSession
        self.entities: dict[str, dict[str, str]] = {}
        self.relationships: dict[str, tuple[str, str]] = {}
        self.graphs: dict[str, list[str]] = {}

    def run(self, text: str) -> list[DataFrame]:
        """The rows of each question; all else changes the graph or what is defined."""
        tokens, out = _TOKEN.findall(re.sub(r"//[^\n]*", "", text)), []
        starts = [i for i, t in enumerate(tokens) if t.upper() in _STATEMENT]
        for a, b in zip(starts, [*starts[1:], len(tokens)], strict=True):
            found = getattr(self, "_" + tokens[a].lower())(tokens[a + 1 : b])
            out += [] if found is None else [found]
        return out

    @staticmethod
    def _value(t: str) -> str:
        return re.sub(r"\\\\(.)", r"\\1", t[1:-1]) if t.startswith('"') else t

    def _define(self, t: list[str]) -> None:
        if t[0].lower() == "entity":
            at = next((i for i, x in enumerate(t) if x.upper() == "PROPERTIES"), len(t))
            self.entities[t[1]] = {t[i - 1]: t[i + 1] for i in range(at, len(t) - 1) if t[i].upper() == "AS"}
        elif t[0].lower() == "relationship":
            self.relationships[t[1]] = (t[3], t[5])
        else:
            raise ValueError(f"not to be defined: {t[0]}")

    def _declare(self, t: list[str]) -> None:
        self.graphs[t[1]] = [x for x in t[3:] if x not in (",",) and x.upper() not in ("ENTITIES", "RELATIONSHIPS", "END")]

    def _pairs(self, t: list[str]) -> dict[str, str]:
        at = next((i for i, x in enumerate(t) if x.upper() == "WITH"), None)
        rest = [] if at is None else [x for x in t[at + 1 :] if x != ","]
        return {rest[i]: self._value(rest[i + 1]) for i in range(0, len(rest) - 1, 2)}

    def _assert(self, t: list[str]) -> None:
        given = self._pairs(t)
        if self.entities.get(t[0]) and (loose := set(given) - set(self.entities[t[0]])):
            raise ValueError(f"{t[0]} has no {', '.join(sorted(loose))}")
        row = self.spark.createDataFrame([(t[1], t[0], given)], "id string, type string, properties map<string,string>")
        self.graph = Graph(self.graph.nodes.unionByName(row, allowMissingColumns=True), self.graph.edges)

    def _establish(self, t: list[str]) -> None:
        kind, a, b = t[0], t[2], t[4]
        if kind in self.relationships:
            ends = {r["id"]: r["type"] for r in self.graph.nodes.filter(F.col("id").isin(a, b)).select("id", "type").collect()}
            if (ends.get(a), ends.get(b)) != self.relationships[kind]:
                raise ValueError(f"{kind} connects {' to '.join(self.relationships[kind])}")
        row = self.spark.createDataFrame([(a, b, kind)], "src string, dst string, type string")
        self.graph = Graph(self.graph.nodes, self.graph.edges.unionByName(row, allowMissingColumns=True))

    def _when(self, t: list[str]) -> None:
        at = next(i for i, x in enumerate(t) if x.upper() == "THEN")
        steps = [t[i : i + 3] for i in range(0, at, 4)]
        edges = self.graph.edges if "weight" in self.graph.edges.columns else self.graph.edges.withColumn("weight", F.lit(1.0))
        found = match(edges, Pattern([], [EdgeSpec(a, b, k) for a, k, b in steps]))
        a, kind, b = t[at + 1 : at + 4]
        new = found.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("type")).distinct()
        new = new.join(self.graph.edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti")
        self.graph = Graph(self.graph.nodes, self.graph.edges.unionByName(new, allowMissingColumns=True))

    def _find(self, t: list[str]) -> DataFrame:
        some = t[0].upper() == "SOME"
        t = t[1:] if t[0].upper() in ("ALL", "SOME") else t
        kind, name = t[0], t[1]
        part = lambda word, ends: next(([*t[i + 1 : next((j for j in range(i + 1, len(t)) if t[j].upper() in ends), len(t))]] for i, x in enumerate(t) if x.upper() == word), [])
        where, during, order = part("WHERE", ("DURING", "ORDERED")), part("DURING", ("ORDERED",)), part("ORDERED", ())
        edges = self.graph.edges
        if during:
            a, b = (F.lit(during[i]).cast(edges.schema["valid_from"].dataType) for i in (1, 3))
            edges = edges.filter(overlaps(F.col("valid_from"), F.col("valid_to"), a, b))
        rows = self.graph.nodes.filter(F.col("type") == kind)
        for i in range(0, len(where), 4):  # conditions of three words, AND between them
            left, op, right = where[i : i + 3]
            if left.startswith(f"{name}."):
                value, c = self._value(right), prop(left.split(".", 1)[1])
                number = re.fullmatch(r"-?\d+(\.\d+)?", right)
                rows = rows.filter(compare(c.try_cast("double") if number else c, op, float(value) if number else value))
            elif left == name:
                rows = rows.join(edges.filter((F.col("type") == op) & (F.col("dst") == right)).select(F.col("src").alias("id")), "id", "left_semi")
            else:
                rows = rows.join(edges.filter((F.col("type") == op) & (F.col("src") == left)).select(F.col("dst").alias("id")), "id", "left_semi")
        if order:
            c = prop(order[1].split(".", 1)[1])
            keys = [c.try_cast("double"), c]
            rows = rows.orderBy(*[k.desc() if order[-1].upper() == "DESC" else k.asc() for k in keys], "id")
        return rows.limit(1) if some else rows
