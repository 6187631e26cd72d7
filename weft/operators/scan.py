"""Scans, look-ups and changes of graphs. Changes are new DataFrames: append, replace by key, anti join."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.scalars import merge
from weft.plans.lineage import broadcast_if_small
from weft.sources.tables import Graph


def scan(rows: DataFrame, kind: str | None = None, where: Column | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows of a type that a filter keeps; offset and limit count rows that were kept."""
    if kind is not None:
        rows = rows.filter(F.col("type") == kind)
    if where is not None:
        rows = rows.filter(where)
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def multi_get(rows: DataFrame, ids: Iterable | DataFrame, key: str = "id") -> DataFrame:
    """Rows with one of the ids: a short list is a filter, a DataFrame (of column key) a semi join."""
    if isinstance(ids, DataFrame):
        return rows.join(broadcast_if_small(ids), key, "left_semi")
    return rows.filter(F.col(key).isin(list(ids)))


def edges_between(edges: DataFrame, a, b, directed: bool = True) -> DataFrame:
    there = (F.col("src") == a) & (F.col("dst") == b)
    return edges.filter(there if directed else there | ((F.col("src") == b) & (F.col("dst") == a)))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse."""
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def neighbors(edges: DataFrame, of, direction: str = "out") -> DataFrame:
    """(node): distinct neighbours of a node, by direction out, in or both."""
    out = edges.filter(F.col("src") == of).select(F.col("dst").alias("node"))
    back = edges.filter(F.col("dst") == of).select(F.col("src").alias("node"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def with_relationships(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with an array of their edges (direction, other, type); edges meet nodes by one shuffle on the id."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.struct(F.lit("out").alias("direction"), F.col("dst").alias("other"), "type").alias("r")), F.struct(F.col("dst").alias("id"), F.struct(F.lit("in").alias("direction"), F.col("src").alias("other"), "type").alias("r"))))
    each = edges.select(ends.alias("e")).select("e.id", "e.r").join(nodes.select("id"), "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_list("r")).alias("relationships"))
    return nodes.join(each, "id", "left")


def insert(rows: DataFrame, more: DataFrame) -> DataFrame:
    return rows.unionByName(more, allowMissingColumns=True)


def insert_new(rows: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    """Only those whose key is not there yet, each once."""
    return insert(rows, more.dropDuplicates([key]).join(rows.select(key), key, "left_anti"))


def upsert(rows: DataFrame, changes: DataFrame, key: str = "id", version: str | None = None) -> DataFrame:
    """Rows with columns replaced by those of changes where these are not null, and new rows; a version counts up.

    changes has each key once.
    """
    given = {c for c in changes.columns if c != key}
    new = changes.select(F.col(key).alias("_key"), F.lit(True).alias("_changed"), *[F.col(c).alias(f"_new_{c}") for c in given])
    met = rows.join(new, F.col(key) == F.col("_key"), "full_outer")
    out = []
    for c in rows.columns:
        if c == key:
            out.append(F.coalesce(F.col(key), F.col("_key")).alias(key))
        elif c == version:
            out.append((F.coalesce(F.col(c), F.lit(0)) + F.when(F.col("_changed"), 1).otherwise(0)).alias(c))
        else:
            out.append(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in given else F.col(c))
    return met.select(*out)


def delete(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(broadcast_if_small(ids.select(key)), key, "left_anti")


def delete_nodes(graph: Graph, ids: DataFrame) -> Graph:
    """Without the nodes of ids (id), and without the edges at either end."""
    gone = broadcast_if_small(ids.select("id").distinct())
    edges = graph.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return Graph(graph.nodes.join(gone, "id", "left_anti"), edges)


def apply_changes(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """A batch of mixed changes: columns of rows and op (insert, update or delete), each key once."""
    kept = delete(rows, changes.filter(F.col("op") == "delete"), key)
    return upsert(kept, changes.filter(F.col("op") != "delete").drop("op"), key)


def split_edge(edges: DataFrame, a, b, node) -> DataFrame:
    """Every edge from a to b replaced by two with a node in between; all else is kept."""
    there = (F.col("src") == a) & (F.col("dst") == b)
    halves = edges.filter(there)
    return edges.filter(~F.coalesce(there, F.lit(False))).unionByName(halves.withColumn("dst", F.lit(node))).unionByName(halves.withColumn("src", F.lit(node)))


def triangle(edges: DataFrame, a, b, node, kind: str = "CONNECTED") -> DataFrame:
    """Two edges more, from both ends of the edges from a to b to a node."""
    there = edges.filter((F.col("src") == a) & (F.col("dst") == b)).limit(1)
    ends = F.explode(F.array(F.lit(a), F.lit(b)))
    return edges.unionByName(there.withColumn("src", ends).withColumns({"dst": F.lit(node), "type": F.lit(kind)}))


def missing_endpoints(graph: Graph) -> DataFrame:
    """(node, side): ends of edges that no node has."""
    ids = graph.nodes.select(F.col("id").alias("node"))
    side = lambda c: graph.edges.select(F.col(c).alias("node")).distinct().join(ids, "node", "left_anti").withColumn("side", F.lit(c))
    return side("src").unionByName(side("dst"))


def valid_edges(graph: Graph, more: DataFrame) -> DataFrame:
    """Those of more whose ends are both nodes."""
    ids = graph.nodes.select("id")
    return more.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def set_property(nodes: DataFrame, where: Column, name: str, value: Column) -> DataFrame:
    new = merge("properties", F.create_map(F.lit(name), value.cast("string")))
    return nodes.withColumn("properties", F.when(F.coalesce(where, F.lit(False)), new).otherwise(F.col("properties")))


def create_group(members: DataFrame, group, path: str) -> tuple[DataFrame, DataFrame]:
    """A group's row (group_id, hierarchy, depth) and its members (group_id, node)."""
    spark = members.sparkSession
    row = spark.range(1).select(F.lit(group).alias("group_id"), F.lit(path).alias("hierarchy"), F.size(F.split(F.lit(path), "/")).alias("depth"))
    return row, members.select(F.lit(group).alias("group_id"), "node").distinct()
