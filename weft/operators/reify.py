"""Edges as nodes: reify and back, relations between relations, evidence, confidence, conflicts and versions.

Edges here have ids: (id, src, dst, type, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.traverse import bfs


def reify(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, original_type, all other columns of the edge) and edges (src, dst, type FROM or TO)."""
    node = F.concat(F.lit("r:"), F.col("id").cast("string"))
    rest = [c for c in edges.columns if c not in ("id", "src", "dst", "type")]
    nodes = edges.select(node.alias("id"), F.col("type").alias("original_type"), *rest)
    ends = F.explode(F.array(F.struct(node.alias("src"), F.col("src").cast("string").alias("dst"), F.lit("FROM").alias("type")), F.struct(node.alias("src"), F.col("dst").cast("string").alias("dst"), F.lit("TO").alias("type"))))
    return nodes, edges.select(ends.alias("e")).select("e.*")


def unreify(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The edges again, with their properties; what lacks an end is left out."""
    end = lambda kind, name: links.filter(F.col("type") == kind).select(F.col("src").alias("id"), F.col("dst").alias(name))
    met = nodes.join(end("FROM", "src"), "id").join(end("TO", "dst"), "id")
    rest = [c for c in nodes.columns if c not in ("id", "original_type")]
    return met.select(F.substring(F.col("id"), 3, 2**30).alias("id"), "src", "dst", F.col("original_type").alias("type"), *rest)


def reify_valid(edges: DataFrame, ids: DataFrame) -> tuple[tuple[DataFrame, DataFrame], DataFrame]:
    """Reifies the edges asked for (id) in one pass; and the ids that no edge has."""
    return reify(edges.join(ids.select("id").distinct(), "id", "left_semi")), ids.select("id").distinct().join(edges.select("id"), "id", "left_anti")


def reify_again(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links of reified edges, reified in turn: the next meta level."""
    named = links.withColumn("id", F.concat_ws("/", "src", "type"))
    return reify(named)


def reified_of_type(nodes: DataFrame, kind: str | None = None) -> DataFrame:
    return nodes if kind is None else nodes.filter(F.col("original_type") == kind)


def match_reified(nodes: DataFrame, links: DataFrame, kind: str | None = None, where: Column | None = None) -> DataFrame:
    """(source, id, target): FROM and TO around reified nodes of a type."""
    chosen = reified_of_type(nodes, kind)
    chosen = chosen if where is None else chosen.filter(where)
    end = lambda k, name: links.filter(F.col("type") == k).select(F.col("src").alias("id"), F.col("dst").alias(name))
    return chosen.select("id").join(end("FROM", "source"), "id").join(end("TO", "target"), "id").select("source", "id", "target")


def hierarchy(links: DataFrame, node: str, most: int = 10) -> DataFrame:
    """(node, depth) below a reified node, over FROM and TO."""
    return bfs(links, links.sparkSession.range(1).select(F.lit(node).alias("node")), most)


def meta_of(meta: DataFrame, relation) -> DataFrame:
    """(other, type): relations that a relation is tied to, from either side."""
    a = meta.filter(F.col("rel1") == relation).select(F.col("rel2").alias("other"), "type")
    return a.unionByName(meta.filter(F.col("rel2") == relation).select(F.col("rel1").alias("other"), "type"))


def conflicts(meta: DataFrame, relations: DataFrame, least: float = 0.8) -> DataFrame:
    """(rel1, rel2, c1, c2): contradictions between relations (id, confidence) that are both surer than `least`."""
    side = lambda n: relations.select(F.col("id").alias(f"rel{n}"), F.col("confidence").alias(f"c{n}"))
    met = meta.filter(F.col("type") == "contradicts").join(side(1), "rel1").join(side(2), "rel2")
    return met.filter((F.col("c1") > least) & (F.col("c2") > least)).select("rel1", "rel2", "c1", "c2")


def confidence(relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, confidence, pieces): the given confidence, else the mean reliability of the evidence (rel, reliability), else null."""
    mean = evidence.groupBy(F.col("rel").alias("id")).agg(F.avg("reliability").alias("mean"), F.count("*").alias("pieces"))
    met = relations.join(mean, "id", "left")
    return met.select("id", F.coalesce("confidence", "mean").alias("confidence"), F.coalesce("pieces", F.lit(0)).alias("pieces"))


def support(meta: DataFrame, evidence: DataFrame) -> DataFrame:
    """(rel, supporters, contradictors, pieces): what speaks for and against each relation."""
    by = meta.groupBy(F.col("rel2").alias("rel")).agg(F.count_if(F.col("type") == "supports").alias("supporters"), F.count_if(F.col("type") == "contradicts").alias("contradictors"))
    pieces = evidence.groupBy("rel").agg(F.count("*").alias("pieces"))
    return by.join(pieces, "rel", "full_outer").fillna(0, ["supporters", "contradictors", "pieces"])


def update(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """Versions (id, version, ...) and new rows for changes (id, ...), one version above the last."""
    last = versions.groupBy("id").agg(F.max("version").alias("_last"))
    new = changes.join(last, "id", "left").withColumn("version", (F.coalesce("_last", F.lit(0)) + 1).cast(versions.schema["version"].dataType)).drop("_last")
    return versions.unionByName(new, allowMissingColumns=True)


def history(versions: DataFrame) -> DataFrame:
    """Versions with rank 1 for the last of each id."""
    return versions.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("version"))))


def attach(links: DataFrame, node: str, other: str, kind: str) -> DataFrame:
    """One more edge at a reified node."""
    return links.unionByName(links.sparkSession.range(1).select(F.lit(node).alias("src"), F.lit(other).alias("dst"), F.lit(kind).alias("type")))


def statistics(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(original_type, reified, complete): reified edges by type, and those with both ends."""
    ends = links.filter(F.col("type").isin("FROM", "TO")).groupBy(F.col("src").alias("id")).agg(F.countDistinct("type").alias("n"))
    return nodes.join(ends, "id", "left").groupBy("original_type").agg(F.count("*").alias("reified"), F.count_if(F.col("n") == 2).alias("complete"))
