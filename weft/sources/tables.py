"""Graph views of the star schema's tables: nodes, typed edges, baskets, facts and triples.

A view is a projection of its table, so filters and the columns that are asked for reach the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Node type: id's first letter, table, key, label, and the columns that become properties.
NODE_VIEWS = {
    "Region": ("R", "region", "r_regionkey", "r_name", ()),
    "Nation": ("N", "nation", "n_nationkey", "n_name", ("n_regionkey",)),
    "Customer": ("C", "customer", "c_custkey", "c_name", ("c_mktsegment", "c_acctbal")),
    "Supplier": ("S", "supplier", "s_suppkey", "s_name", ("s_acctbal",)),
    "Part": ("P", "part", "p_partkey", "p_name", ("p_brand", "p_type", "p_size")),
    "Order": ("O", "orders", "o_orderkey", "o_orderpriority", ("o_orderstatus",)),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(letter: str, key: str | Column) -> Column:
    return F.concat(F.lit(letter), (F.col(key) if isinstance(key, str) else key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """(id, type, label, properties map) of the types asked for, or of all."""
    out = []
    for t in types or NODE_VIEWS:
        letter, name, key, label, props = NODE_VIEWS[t]
        pairs = [x for p in props for x in (F.lit(p), F.col(p).cast("string"))]
        properties = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        out.append(read(spark, sf_dir, name).select(node_id(letter, key).alias("id"), F.lit(t).alias("type"), F.col(label).alias("label"), properties.alias("properties")))
    return reduce(DataFrame.unionByName, out)


def _edge(df: DataFrame, kind: str, src: Column, dst: Column, weight: Column, since: Column | None = None, until: Column | None = None) -> DataFrame:
    never = F.lit(None).cast("timestamp_ntz")
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), weight.cast("double").alias("weight"), (never if since is None else since).alias("valid_from"), (never if until is None else until).alias("valid_to"))


def edges(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """(src, dst, type, weight, valid_from, valid_to) of the types asked for, or of all but DID."""
    t = lambda name: read(spark, sf_dir, name)
    views = {
        "IN_REGION": lambda: _edge(t("nation"), "IN_REGION", node_id("N", "n_nationkey"), node_id("R", "n_regionkey"), F.lit(1)),
        "LOCATED_IN": lambda: _edge(t("customer"), "LOCATED_IN", node_id("C", "c_custkey"), node_id("N", "c_nationkey"), F.col("c_acctbal")).unionByName(_edge(t("supplier"), "LOCATED_IN", node_id("S", "s_suppkey"), node_id("N", "s_nationkey"), F.col("s_acctbal"))),
        "PLACED": lambda: _edge(t("orders"), "PLACED", node_id("C", "o_custkey"), node_id("O", "o_orderkey"), F.col("o_totalprice"), F.col("o_orderdate")),
        "CONTAINS": lambda: _edge(t("lineitem"), "CONTAINS", node_id("O", "l_orderkey"), node_id("P", "l_partkey"), F.col("l_quantity"), F.col("l_shipdate")),
        "SUPPLIES": lambda: _edge(
            t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"), F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b")),
            "SUPPLIES", node_id("S", "l_suppkey"), node_id("P", "l_partkey"), F.col("q"), F.col("a"), F.col("b"),
        ),
        "DID": lambda: _edge(t("events"), "DID", node_id("C", "user_id"), node_id("E", "event_id"), F.col("value"), F.col("ts")),
    }
    return reduce(DataFrame.unionByName, [views[k]() for k in types or [k for k in views if k != "DID"]])


@dataclass
class Graph:
    """Nodes (id, ...) and edges (src, dst, type, weight, ...)."""

    nodes: DataFrame
    edges: DataFrame


def graph(spark: SparkSession, sf_dir: str, node_types: tuple = (), edge_types: tuple = ()) -> Graph:
    return Graph(nodes(spark, sf_dir, *node_types), edges(spark, sf_dir, *edge_types))


def baskets(spark: SparkSession, sf_dir: str, member: str = "l_partkey") -> DataFrame:
    """(hid, node): orders as hyperedges over the distinct members of their lines."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("hid"), F.col(member).alias("node")).distinct()


def basket_pairs(spark: SparkSession, sf_dir: str, member: str = "l_partkey") -> DataFrame:
    """(src, dst): members that share an order, src < dst, once for each order. Orders are put together once, not joined."""
    of = F.col("l_orderkey").alias("hid")
    lines = read(spark, sf_dir, "lineitem").select(of, F.col(member).alias("node")).filter("hid is not null and node is not null")
    sets = lines.groupBy("hid").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    each = sets.select("nodes", F.posexplode("nodes").alias("at", "src"))
    return each.select("src", F.explode(F.slice("nodes", F.col("at") + 2, F.size("nodes"))).alias("dst"))


def basket_graph(spark: SparkSession, sf_dir: str, member: str = "l_partkey") -> DataFrame:
    """(src, dst, weight): members that share an order, src < dst, weighted by the number of orders. Orders are short."""
    return basket_pairs(spark, sf_dir, member).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, predicate, object, valid_from, valid_to, confidence): each order is a customer's current one until the next."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject"), F.lit("ordered").alias("predicate"), F.col("o_orderkey").alias("object"),
        F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_to"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.5).alias("confidence"),
    )


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o): customers, suppliers, nations and regions, a triple for each column."""
    parts = []
    for letter, name, key, columns in (
        ("C", "customer", "c_custkey", ("c_name", "c_nationkey", "c_mktsegment")),
        ("S", "supplier", "s_suppkey", ("s_name", "s_nationkey")),
        ("N", "nation", "n_nationkey", ("n_name", "n_regionkey")),
        ("R", "region", "r_regionkey", ("r_name",)),
    ):
        to = {"c_nationkey": "N", "s_nationkey": "N", "n_regionkey": "R"}
        said = F.array(*(F.struct(F.lit(c[2:]).alias("p"), (node_id(to[c], c) if c in to else F.col(c)).alias("o")) for c in columns))
        parts.append(read(spark, sf_dir, name).select(node_id(letter, key).alias("s"), F.explode(said).alias("x")).select("s", "x.p", "x.o"))
    return reduce(DataFrame.unionByName, parts)


def partitioned(edges: DataFrame, how: str, n: int, cuts: list | None = None) -> DataFrame:
    """edges with shard: hash (of src), range (of src, by the bounds in cuts), edge-cut (src and dst each keep the edge: a row for
    each of their shards), vertex-cut (of both ends together), hybrid (of dst, where few edges end there, else of src)."""
    place = lambda *c: F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(x).cast("string") for x in c]).cast("binary")), 1, 8), 16, 10).cast("long") % n
    if how == "hash":
        return edges.withColumn("shard", place("src"))
    if how == "range":
        return edges.withColumn("shard", sum((F.when(F.col("src") >= c, 1).otherwise(0) for c in cuts or []), F.lit(0)).cast("long"))
    if how == "edge-cut":
        return edges.withColumn("shard", F.explode(F.array_distinct(F.array(place("src"), place("dst")))))
    if how == "vertex-cut":
        return edges.withColumn("shard", place("src", "dst"))
    many = edges.groupBy("dst").agg(F.count("*").alias("_n"))
    return edges.join(many, "dst").withColumn("shard", F.when(F.col("_n") <= 100, place("dst")).otherwise(place("src"))).drop("_n")


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, first, degree, targets): compressed rows: where a node's edges begin in the order of all, their number, their ends."""
    from weft.operators.aggregate import numbered

    e = numbered(edges.select("src", "dst").distinct(), [F.asc("src"), F.asc("dst")], "at")
    return e.groupBy("src").agg((F.min("at") - 1).alias("first"), F.count("*").alias("degree"), F.sort_array(F.collect_list("dst")).alias("targets"))
