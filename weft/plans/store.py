"""A graph that changes in transactions, results that are kept, and times of queries."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.operators import scan
from weft.plans.lineage import table
from weft.sources.tables import Graph


class Transaction:
    """Changes to a graph that others see only after commit(); each gives new DataFrames, so a rollback just drops them."""

    def __init__(self, store: Store):
        self.store, self.graph, self.began, self.open = store, store.graph, store.version, True

    def change(self, f: Callable[[Graph], Graph]) -> Transaction:
        if not self.open:
            raise ValueError("the transaction has ended")
        self.graph = f(self.graph)
        return self

    def insert(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Transaction:
        return self.change(lambda g: Graph(g.nodes if nodes is None else scan.insert_new(g.nodes, nodes), g.edges if edges is None else scan.insert(g.edges, edges)))

    def delete(self, ids: DataFrame) -> Transaction:
        return self.change(lambda g: scan.delete_nodes(g, ids))

    def commit(self) -> int:
        """The new version; refused if another transaction has committed since this one began, or an edge lacks an end."""
        if not self.open or self.began != self.store.version:
            self.open = False
            raise ValueError("the graph has changed since the transaction began")
        done = Graph(table(self.graph.nodes, "commit-nodes"), table(self.graph.edges, "commit-edges"))
        if not scan.missing_endpoints(done).isEmpty():
            self.open = False
            raise ValueError("an edge has an end that is no node")
        self.store.graph, self.store.version, self.open = done, self.began + 1, False
        return self.store.version

    def rollback(self) -> None:
        self.open = False


class Store:
    """The last committed graph, its version, kept results and times."""

    def __init__(self, graph: Graph):
        self.graph, self.version = graph, 0
        self.kept: dict[tuple, DataFrame] = {}
        self.hits = 0
        self.times: list[tuple[str, float, int]] = []

    def begin(self) -> Transaction:
        return Transaction(self)

    def result(self, df: DataFrame, name: str = "kept") -> DataFrame:
        """df, written the first time and read the next times the same plan is asked for while the graph is the same."""
        key = self.version, df.semanticHash()
        if key in self.kept and self.kept[key][0].sameSemantics(df):
            self.hits += 1
        else:
            self.kept[key] = df, table(df, name)
        return self.kept[key][1]

    def timed(self, name: str, df: DataFrame) -> int:
        """Rows of df, counted while the time is taken."""
        start = time.perf_counter()
        n = df.count()
        self.times.append((name, time.perf_counter() - start, n))
        return n

    def slow(self, spark: SparkSession, seconds: float) -> DataFrame:
        """(name, seconds, rows) of what took so long or longer."""
        return spark.createDataFrame([t for t in self.times if t[1] >= seconds], "name string, seconds double, rows long")
