"""Hypergraphs as incidence tables (hid, node), groups, and likeness of nodes by what they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators import cells
from weft.plans.lineage import broadcast_if_small, table


def sizes(members: DataFrame) -> DataFrame:
    return members.distinct().groupBy("hid").agg(F.count("*").alias("size"))


def find(members: DataFrame, required: list | None = None, least: int = 0, most: int | None = None, kinds: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """(hid, size) of hyperedges of a type (kinds: hid, type), with a size in bounds and all required members."""
    m = members.distinct()
    if kind is not None:
        m = m.join(kinds.filter(F.col("type") == kind).select("hid"), "hid", "left_semi")
    there = F.count_if(F.col("node").isin(required)) if required else F.lit(0)
    found = m.groupBy("hid").agg(F.count("*").alias("size"), there.alias("n")).filter((F.col("size") >= least) & (F.col("n") == len(set(required or []))))
    return (found if most is None else found.filter(F.col("size") <= most)).select("hid", "size")


def unknown_members(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members that no node has: what stops a hyperedge from being created."""
    return members.join(nodes.select(F.col("id").alias("node")), "node", "left_anti")


def hyperdegree(members: DataFrame) -> DataFrame:
    return members.distinct().groupBy("node").agg(F.count("*").alias("degree"))


def mean_size(members: DataFrame) -> DataFrame:
    return sizes(members).agg(F.avg("size").alias("mean_size"), F.count("*").alias("hyperedges"))


def create(members: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hyperedges of which all members are nodes (id), and the (hid, missing) of the others, which are not created."""
    missing = unknown_members(members.distinct(), nodes).groupBy("hid").agg(F.count("*").alias("missing"))
    return members.join(missing, "hid", "left_anti"), missing


#: Members of a hyperedge that are paired in one task.
BLOCK = 1000


def co_members(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, shared), a < b: pairs in the same hyperedge. A large hyperedge is dealt to blocks, and each two blocks are paired apart."""
    m = members.select("hid", "node").distinct()
    many = sizes(m).filter(F.col("size") > block).select("hid", F.ceil(F.col("size") / block).cast("int").alias("k"))
    m = m.join(many, "hid", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    m = m.withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    left = m.select("hid", F.col("node").alias("a"), F.col("own").alias("i"), every.alias("j"))
    right = m.select("hid", F.col("node").alias("b"), F.col("own").alias("j"), every.alias("i"))
    pairs = left.join(right, ["hid", "i", "j"]).filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def similarity(members: DataFrame, kind: str = "jaccard") -> DataFrame:
    """(a, b, similarity) of nodes that share a hyperedge: jaccard or cosine over their hyperedges."""
    d = hyperdegree(members)
    p = co_members(members).join(d.select(F.col("node").alias("a"), F.col("degree").alias("da")), "a").join(d.select(F.col("node").alias("b"), F.col("degree").alias("db")), "b")
    by = {"jaccard": F.col("shared") / (F.col("da") + F.col("db") - F.col("shared")), "cosine": F.col("shared") / F.sqrt((F.col("da") * F.col("db")).cast("double"))}
    return p.select("a", "b", by[kind].alias("similarity"))


def structural_similarity(edges: DataFrame) -> DataFrame:
    """(a, b, similarity): Jaccard over neighbours, of nodes that share one."""
    return cells.structural_similarity(edges)


def similarity_rows(edges: DataFrame) -> DataFrame:
    """(a, n, most, total): all rows of structural_similarity, summed by the first node before they become rows."""
    return cells.similarity_rows(edges)


def ball(members: DataFrame, node, radius: int) -> DataFrame:
    """(node, depth): nodes within so many hyperedges."""
    m = table(members.distinct(), "incidence")
    seen = front = table(m.sparkSession.range(1).select(F.lit(node).alias("node"), F.lit(0).alias("depth")), "ball")
    for depth in range(1, radius + 1):
        hids = m.join(broadcast_if_small(front.select("node")), "node").select("hid").distinct()
        step = m.join(broadcast_if_small(hids), "hid").select("node").distinct()
        front = table(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "ball")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def clusters(members: DataFrame, node, radius: int, least: int) -> DataFrame:
    """The ball, if it has at least so many nodes; else nothing."""
    found = ball(members, node, radius)
    return found if found.count() >= least else found.limit(0)


def shortest_path(members: DataFrame, source, target, most: int = 10) -> DataFrame:
    """(nodes, hyperedges): one shortest path of nodes and of the hyperedges between them, the least by ids; empty if there is none."""
    m = table(members.distinct(), "incidence")
    depth = table(ball(m, target, most), "ball")
    found = depth.filter(F.col("node") == source).first()
    now = m.sparkSession.range(1).select(F.array(F.lit(source)).alias("nodes"), F.lit(source).alias("node"), F.array().cast(f"array<{m.schema['hid'].dataType.simpleString()}>").alias("hyperedges"))
    if found is None:
        return now.limit(0).select("nodes", "hyperedges")
    for left in range(found["depth"] - 1, -1, -1):
        near = depth.filter(F.col("depth") == left).select(F.col("node").alias("to"))
        step = now.join(m, "node").join(m.select("hid", F.col("node").alias("to")), "hid").join(near, "to", "left_semi")
        step = step.select(F.array_append("nodes", F.col("to")).alias("nodes"), F.col("to").alias("node"), F.array_append("hyperedges", F.col("hid")).alias("hyperedges"))
        now = step.groupBy("node").agg(F.min(F.struct("nodes", "hyperedges")).alias("p")).select("p.nodes", "node", "p.hyperedges")
    return now.select("nodes", "hyperedges")


def paths(members: DataFrame, source, target, most: int) -> DataFrame:
    """(nodes, length): all paths without repeated nodes over at most so many hyperedges."""
    from weft.operators.traverse import simple_paths

    pairs = co_members(members).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = simple_paths(pairs, source, target, most, "both")
    return found.select(F.col("path").alias("nodes"), "length")


def eigenvector(members: DataFrame, iterations: int = 20) -> DataFrame:
    """(node, value): each hyperedge of size k gives a member 1 / (k - 1) of the sum of the others; length 1 each round."""
    m = table(members.distinct(), "incidence")
    m = table(m.join(sizes(m), "hid").filter("size > 1"), "incidence")
    x = table(m.select("node").distinct().withColumn("value", F.lit(1.0)), "hyper")
    for _ in range(iterations):
        met = m.join(x, "node")
        sums = met.groupBy("hid").agg(F.sum("value").alias("all"))
        got = met.join(sums, "hid").groupBy("node").agg(F.sum((F.col("all") - F.col("value")) / (F.col("size") - 1)).alias("value"))
        got = table(got, "hyper")
        length = got.agg(F.sqrt(F.sum(F.col("value") * F.col("value")))).first()[0] or 1.0
        x = got.withColumn("value", F.col("value") / length)
    return x


def betweenness(members: DataFrame, sources: DataFrame) -> DataFrame:
    """Betweenness over the pairs of co-members, from a stated set of sources (node)."""
    from weft.operators.analytics import betweenness as between

    return between(co_members(members).select(F.col("a").alias("src"), F.col("b").alias("dst")), sources, "both")


def modularity_clusters(members: DataFrame) -> DataFrame:
    """(node, community) by joining communities of co-members as long as modularity rises."""
    from weft.operators.analytics import greedy_modularity

    return greedy_modularity(co_members(members).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("shared").cast("double").alias("weight")))


def match_incidence(members: DataFrame, kinds: DataFrame, steps: list[tuple[str, str, str]]) -> DataFrame:
    """Bindings of nodes and hyperedges: steps (node alias, hyperedge alias, type) that share aliases; different aliases differ."""
    out, bound = None, []
    typed = members.distinct().join(kinds, "hid")
    for a, h, kind in steps:
        step = typed.filter(F.col("type") == kind).select(F.col("node").alias(a), F.col("hid").alias(h))
        shared = [x for x in (a, h) if x in bound]
        out = step if out is None else out.join(step, shared) if shared else out.crossJoin(step)
        bound += [x for x in (a, h) if x not in bound]
    nodes = list(dict.fromkeys(a for a, _, _ in steps))
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            out = out.filter(F.col(a) != F.col(b))
    return out


def communities(members: DataFrame, rounds: int = 5) -> DataFrame:
    """Label propagation weighted by shared hyperedges, for so many rounds."""
    from weft.operators.analytics import label_propagation

    return label_propagation(co_members(members).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("shared").cast("double").alias("weight")), rounds, weighted=True)


def export(members: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """(line): a JSON object for each hyperedge, with its members in order."""
    sets = members.groupBy("hid").agg(F.array_sort(F.collect_set("node")).alias("members"))
    rows = sets if header is None else sets.join(header, "hid")
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def meta(edges: DataFrame, first: Column, second: Column, kind: str, known: DataFrame | None = None) -> DataFrame:
    """(id1, id2, type): pairs of edges that are related, from rows that name both; both must exist, in known (id) if that is given."""
    pairs = edges.select(first.alias("id1"), second.alias("id2"), F.lit(kind).alias("type")).filter("id1 is not null and id2 is not null")
    if known is not None:
        for c in ("id1", "id2"):
            pairs = pairs.join(known.select(F.col("id").alias(c)), c, "left_semi")
    return pairs.select("id1", "id2", "type")


def nth_in_group(rows: DataFrame, by: str, order: str) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(order)))
