"""Graph analytics as loops of joins and aggregations; the state is written after each round.

Sums over a node's edges are partial before they are shuffled, so a node with very many edges is no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators import cells
from weft.operators.aggregate import numbered
from weft.operators.match import canonical
from weft.operators.scan import both_ways
from weft.operators.traverse import multi_bfs, shortest_distances
from weft.plans.lineage import table


#: Rounds of a loop that are planned as one before the state is written (and, where there is a tolerance, looked at).
PACE = 3


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame, direction: str = "both", nodes: DataFrame | None = None) -> DataFrame:
    """(node, degree, centrality): edges at each node by direction, and their number over n - 1."""
    ends = {"out": F.array("src"), "in": F.array("dst"), "both": F.array("src", "dst")}[direction]
    nodes = vertices(edges) if nodes is None else nodes.select("node")
    counted = edges.select(F.explode(ends).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    n = nodes.count()
    degree = F.coalesce("degree", F.lit(0)).cast("long")
    return nodes.join(counted, "node", "left").select("node", degree.alias("degree"), (degree / F.lit(float(max(1, n - 1)))).alias("centrality"))


def density(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(nodes, edges, density, average_degree, least_degree, most_degree) of the undirected simple graph."""
    e = canonical(edges)
    d = degrees(e.select(F.col("a").alias("src"), F.col("b").alias("dst")), "both", nodes)
    n, m = F.count("*"), F.sum("degree") / 2
    return d.agg(n.alias("nodes"), m.cast("long").alias("edges"), (2 * m / F.nullif((n * (n - 1)).cast("double"), F.lit(0.0))).alias("density"), F.avg("degree").alias("average_degree"), F.min("degree").alias("least_degree"), F.max("degree").alias("most_degree"))


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6, weighted: bool = False, change: str = "sum") -> DataFrame:
    """(node, rank): ranks start at 1/n; what nodes without outgoing edges have is dropped; stops once a round changes less than
    tolerance in all (change sum) or anywhere (max), which is looked at every PACE rounds."""
    w = "weight" if weighted else F.lit(1.0)
    e = edges.select("src", "dst", (F.col("weight") if weighted else w).alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("total"))
    e = table(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "rank-edges")
    nodes = table(vertices(edges), "rank-nodes")
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(1, n)))
    for i in range(iterations):
        given = e.join(ranks.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("given"))
        rank = F.lit((1 - damping) / max(1, n)) + damping * F.coalesce("given", F.lit(0.0))
        new = ranks.withColumnRenamed("rank", "before").join(given, "node", "left").select("node", rank.alias("rank"), "before")
        cut = (i + 1) % PACE == 0 or i + 1 == iterations
        new = table(new, "ranks") if cut else new
        ranks = new.select("node", "rank")
        if cut and tolerance is not None and (new.agg({"sum": F.sum, "max": F.max}[change](F.abs(F.col("rank") - F.col("before")))).first()[0] or 0) < tolerance:
            break
    return ranks


def _power(edges: DataFrame, iterations: int, tolerance: float | None, step, start: float, written: bool = False) -> DataFrame:
    """written: whether step() writes what it is given."""
    e = table(edges.select("src", "dst").distinct(), "power-edges")
    nodes = table(vertices(edges), "power-nodes")
    x = nodes.withColumn("value", F.lit(start))
    for i in range(iterations):
        got = e.join(x.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("value").alias("got"))
        met = x.withColumnRenamed("value", "before").join(got, "node", "left").withColumn("got", F.coalesce("got", F.lit(0.0)))
        new = step(met)
        cut = written or (i + 1) % PACE == 0 or i + 1 == iterations
        new = table(new, "power") if cut and not written else new
        x = new.select("node", "value")
        if cut and tolerance is not None and (new.agg(F.sum(F.abs(F.col("value") - F.col("before")))).first()[0] or 0) < tolerance:
            break
    return x


def eigenvector(edges: DataFrame, iterations: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """(node, value): power iteration with the vector at length 1; give edges both ways for an undirected graph."""

    def step(met: DataFrame) -> DataFrame:
        met = table(met, "power-sums")  # read for the length and for the vector
        length = met.agg(F.sqrt(F.sum(F.col("got") * F.col("got")))).first()[0] or 0.0
        return met.withColumn("value", F.col("got") / length if length else F.lit(0.0))

    n = max(1, vertices(edges).count())
    return _power(edges, iterations, tolerance, step, n**-0.5, written=True)


def katz(edges: DataFrame, alpha: float = 0.1, beta: float = 1.0, iterations: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    return _power(edges, iterations, tolerance, lambda met: met.withColumn("value", alpha * F.col("got") + beta), 0.0)


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node that each reaches, edges taken both ways; large and small stars in turn."""
    now, before = table(canonical(edges).select(F.col("b").alias("x"), F.col("a").alias("y")), "stars"), None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)")).alias("s")).first()
        if (seen["n"], seen["s"]) == before:
            break
        before = seen["n"], seen["s"]
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").filter(F.col("y") > F.col("x")).select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").filter(F.col("y") != F.col("m")).select(F.col("y").alias("x"), F.col("m").alias("y"))
        now = table(small.unionByName(least.select("x", F.col("m").alias("y"))).distinct(), "stars")
    nodes = vertices(edges) if nodes is None else nodes.select("node")
    return nodes.join(now.select(F.col("x").alias("node"), F.col("y").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def _reach(edges: DataFrame, start: DataFrame, forward: bool) -> DataFrame:
    """Nodes with the colour (pivot) that they are reached with, staying inside a colour."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    seen = front = table(start, "reach")
    while True:
        step = front.select(F.col("node").alias(a), "color").join(edges, [a, "color"]).select(F.col(b).alias("node"), "color").distinct()
        front = table(step.join(seen, ["node", "color"], "left_anti"), "reach")
        if front.isEmpty():
            return seen
        seen = table(seen.unionByName(front), "reach")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each strongly connected component.

    Nodes without edges in or out of their part are alone. In every part the least node is the pivot; what it reaches and
    is reached from is its component; the rest falls into three parts, by which of the two holds.
    """
    nodes = table(vertices(edges).withColumn("color", F.lit("")), "parts")
    e = table(edges.select("src", "dst").filter("src != dst").distinct().withColumn("color", F.lit("")), "part-edges")
    done = None
    while not nodes.isEmpty():  # every round at least each part's pivot finds its component
        while True:  # trim
            alone = table(nodes.join(e.select(F.col("src").alias("node")), "node", "left_anti").unionByName(nodes.join(e.select(F.col("dst").alias("node")), "node", "left_anti")).distinct(), "alone")
            if alone.isEmpty():
                break
            own = alone.select("node", F.col("node").alias("component"))
            done = own if done is None else done.unionByName(own)
            gone = alone.select("node")
            nodes = table(nodes.join(gone, "node", "left_anti"), "parts")
            e = table(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"), "part-edges")
        if nodes.isEmpty():
            break
        pivots = table(nodes.groupBy("color").agg(F.min("node").alias("node")), "pivots")
        ahead = _reach(e, pivots.select("node", "color"), True).withColumn("f", F.lit(1))
        back = _reach(e, pivots.select("node", "color"), False).withColumn("b", F.lit(1))
        met = table(nodes.join(ahead, ["node", "color"], "left").join(back, ["node", "color"], "left").fillna(0, ["f", "b"]).join(pivots.withColumnRenamed("node", "pivot"), "color"), "met")
        own = met.filter("f = 1 and b = 1").select("node", F.col("pivot").alias("component"))
        done = own if done is None else done.unionByName(own)
        rest = met.filter("f = 0 or b = 0").select("node", F.sha2(F.concat_ws("|", "color", F.col("pivot").cast("string"), "f", "b").cast("binary"), 224).alias("color"))
        nodes = table(rest, "parts")
        at = lambda c: nodes.select(F.col("node").alias(c), F.col("color").alias(f"{c}_color"))
        e = table(e.select("src", "dst").join(at("src"), "src").join(at("dst"), "dst").filter("src_color = dst_color").select("src", "dst", F.col("src_color").alias("color")), "part-edges")
    return nodes.select("node", F.col("node").alias("component")) if done is None else done


def triangle_counts(edges: DataFrame) -> DataFrame:
    """(node, triangles) of nodes in any."""
    return cells.triangle_counts(edges)


def clustering(edges: DataFrame) -> DataFrame:
    """(node, degree, triangles, coefficient): triangles over pairs of neighbours, 0 below two neighbours."""
    ways = cells.oriented_cells(edges)
    d = ways.degree.select(F.col("i").alias("node"), F.col("j").alias("degree")).join(cells.counts_of(ways), "node", "left").fillna(0, ["triangles"])
    d = ways.named(d, "node")
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return d.withColumn("coefficient", F.when(pairs > 0, F.col("triangles") / pairs).otherwise(0.0))


def global_clustering(edges: DataFrame) -> DataFrame:
    """(average, transitivity): the mean coefficient, and closed over all pairs of neighbours."""
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return clustering(edges).agg(F.avg("coefficient").alias("average"), (F.sum("triangles") / F.nullif(F.sum(pairs), F.lit(0.0))).alias("transitivity"))


def closeness(edges: DataFrame, sources: DataFrame, direction: str = "out", weighted: bool = False, max_hops: int | None = None) -> DataFrame:
    """(node, reachable, closeness) of a stated set of sources (node): nodes reached over the sum of their distances."""
    found = shortest_distances(edges, sources, direction, max_hops) if weighted else multi_bfs(edges, sources, max_hops, direction).withColumnRenamed("depth", "distance")
    total = F.sum("distance")
    return found.filter("source != node").groupBy(F.col("source").alias("node")).agg(F.count("*").alias("reachable"), (F.count("*") / F.nullif(total.cast("double"), F.lit(0.0))).alias("closeness"))


def eccentricities(edges: DataFrame, sources: DataFrame, direction: str = "both", weighted: bool = False, max_hops: int | None = None) -> DataFrame:
    """(node, eccentricity): the farthest that each of a stated set of sources (node) reaches."""
    found = shortest_distances(edges, sources, direction, max_hops).withColumnRenamed("distance", "depth") if weighted else multi_bfs(edges, sources, max_hops, direction)
    return found.groupBy(F.col("source").alias("node")).agg(F.max("depth").alias("eccentricity"))


def extent(edges: DataFrame, sources: DataFrame, direction: str = "both", weighted: bool = False) -> DataFrame:
    """(diameter, radius, mean_eccentricity, center, periphery) over a stated set of sources (node); the last two count them."""
    e = table(eccentricities(edges, sources, direction, weighted), "eccentricities")
    bounds = e.agg(F.max("eccentricity").alias("diameter"), F.min("eccentricity").alias("radius"), F.avg("eccentricity").alias("mean_eccentricity"))
    met = e.join(F.broadcast(bounds), F.col("eccentricity").between(F.col("radius"), F.col("diameter")))  # one row
    first = lambda c: F.first(c).alias(c)
    return met.agg(first("diameter"), first("radius"), first("mean_eccentricity"), F.count_if(F.col("eccentricity") == F.col("radius")).alias("center"), F.count_if(F.col("eccentricity") == F.col("diameter")).alias("periphery"))


def betweenness(edges: DataFrame, sources: DataFrame, direction: str = "out", normalized: str | None = None, max_depth: int | None = None) -> DataFrame:
    """(node, betweenness) by Brandes from a stated set of sources (node), scaled to all nodes: counts of shortest paths level by
    level from all sources at once, shares back again. normalized: "ordered" over n (n - 1), "pairs" over (n - 1) (n - 2) / 2."""
    from weft.operators.traverse import _steps, directed

    e = table(directed(edges, direction), "between-edges")
    nodes = table(vertices(edges), "between-nodes")
    n = nodes.count()
    chosen = table(sources.select("node").distinct().join(nodes, "node", "left_semi"), "between-sources")
    k = chosen.count()
    seen = table(chosen.select(F.col("node").alias("source"), "node", F.lit(0).alias("depth"), F.lit(1.0).alias("paths")), "between")
    levels = [seen]
    for depth in _steps(max_depth):
        step = levels[-1].select("source", F.col("node").alias("src"), "paths").join(e, "src").groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        known = levels[-1].unionByName(levels[-2]) if direction == "both" and depth > 1 else seen  # neighbours are one level apart at most
        new = table(step.join(known.select("source", "node"), ["source", "node"], "left_anti").select("source", "node", F.lit(depth).alias("depth"), "paths"), "between")
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.unionByName(new)
    share, total = None, None
    for level, above in zip(levels[:0:-1], levels[-2::-1], strict=True):
        own = level.withColumn("share", F.lit(0.0)) if share is None else level.join(share, ["source", "node"], "left").fillna(0.0, ["share"])
        own = table(own, "shares")
        total = own.select("node", "share") if total is None else total.unionByName(own.select("node", "share"))
        up = own.select("source", F.col("node").alias("dst"), ((1 + F.col("share")) / F.col("paths")).alias("x")).join(e, "dst")
        up = up.join(above.select("source", F.col("node").alias("src"), F.col("paths").alias("p")), ["source", "src"])
        share = up.groupBy("source", F.col("src").alias("node")).agg(F.sum(F.col("x") * F.col("p")).alias("share"))
    by = {None: 1.0, "ordered": 1.0 / max(1, n * (n - 1)), "pairs": 2.0 / max(1, (n - 1) * (n - 2))}[normalized]
    scale = (n / k if k else 1.0) * by
    if total is None:
        return nodes.withColumn("betweenness", F.lit(0.0))
    sums = total.groupBy("node").agg((F.sum("share") * scale).alias("betweenness"))
    return nodes.join(sums, "node", "left").fillna(0.0, ["betweenness"])


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) of a minimum spanning forest (Boruvka): every part takes its least edge, then parts are joined.

    Edges are ordered by weight, then ends, so no two are alike and rounds make no cycle.
    """
    e = table(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").filter("src < dst").groupBy("src", "dst").agg(F.min("weight").alias("weight")), "forest-edges")
    cross = table(e.select("src", "dst", "weight", F.col("src").alias("a"), F.col("dst").alias("b")), "forest")
    taken = None
    while not cross.isEmpty():
        edge = F.struct("weight", "src", "dst")
        ends = cross.select(F.explode(F.array("a", "b")).alias("part"), edge.alias("edge"))
        best = ends.groupBy("part").agg(F.min("edge").alias("edge")).select("edge.*").distinct()
        best = table(best, "forest-step")
        taken = best if taken is None else taken.unionByName(best)
        joined = best.join(cross, ["src", "dst", "weight"]).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        parts = table(connected_components(joined), "forest-parts")
        name = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_new"))
        moved = cross.join(name("a"), "a", "left").join(name("b"), "b", "left").select("src", "dst", "weight", F.coalesce("a_new", "a").alias("a"), F.coalesce("b_new", "b").alias("b"))
        cross = table(moved.filter("a != b"), "forest")
    return e.limit(0) if taken is None else taken.select("src", "dst", "weight")


def label_propagation(edges: DataFrame, rounds: int = 5, weighted: bool = False) -> DataFrame:
    """(node, label): every round, the label with most weight among the neighbours; ties go to the least label."""
    e = edges.select("src", "dst", (F.col("weight") if weighted else F.lit(1.0)).alias("w"))
    e = table(both_ways(e), "label-edges")
    labels = table(vertices(edges).withColumn("label", F.col("node")), "labels")
    for _ in range(rounds):
        votes = e.join(labels.withColumnRenamed("node", "src"), "src").groupBy("dst", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy(F.col("dst").alias("node")).agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("label"))
        labels = table(best, "labels")
    return labels


def louvain(edges: DataFrame, rounds: int = 10, levels: int = 3, resolution: float = 1.0) -> DataFrame:
    """(node, community): moves that raise modularity, then communities become nodes, level by level.

    All nodes choose at once, so in a round only those move whose hash falls on the round's side; a round that does not
    raise modularity ends the level. Ties go to the least community.
    """
    if levels < 1:
        return vertices(edges).withColumn("community", F.col("node"))
    return cells.communities(edges.select("src", "dst", F.col("weight").alias("w")), rounds, levels, resolution)


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> float:
    """Of (src, dst, w or weight) and (node, community)."""
    w = "w" if "w" in edges.columns else "weight"
    total = edges.agg(F.sum(w)).first()[0] or 1.0
    c = lambda side: communities.select(F.col("node").alias(side), F.col("community").alias(f"{side}_c"))
    inside = edges.join(c("src"), "src").join(c("dst"), "dst").filter("src_c = dst_c").agg(F.sum(w)).first()[0] or 0.0
    k = edges.select(F.explode(F.array("src", "dst")).alias("node"), F.col(w).alias("w")).join(communities, "node").groupBy("community").agg(F.sum("w").alias("k"))
    return inside / total - resolution * (k.agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0) / (4 * total * total)


def assortativity(edges: DataFrame) -> DataFrame:
    """(assortativity): correlation of the degrees at the ends of edges, each taken both ways."""
    e = both_ways(canonical(edges).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    d = e.groupBy("src").agg(F.count("*").cast("double").alias("x"))
    met = e.join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("x").alias("y")), "dst")
    return met.agg(F.corr("x", "y").alias("assortativity"))


def matrix_vector(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(i, value) of a sparse matrix (i, j, value) times a vector (i, value)."""
    v = vector.select(F.col("i").alias("j"), F.col("value").alias("x"))
    return matrix.join(v, "j").groupBy("i").agg(F.sum(F.col("value") * F.col("x")).alias("value"))


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, value) of two sparse matrices."""
    right = b.select(F.col("i").alias("k"), "j", F.col("value").alias("y"))
    return a.select("i", F.col("j").alias("k"), F.col("value").alias("x")).join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def product_rows(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """(i, n, total): the whole product of two sparse matrices (without b: of a with itself), its entries counted and summed by
    row before they become rows; an entry (i, j) is given once."""
    return cells.product_rows(a, b)


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def kmeans(rows: DataFrame, key: str, vector: str, k: int, seed: int = 7, iterations: int = 20) -> DataFrame:
    """(key, cluster) by Spark's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = rows.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=iterations).fit(x).transform(x).select(key, F.col("prediction").alias("cluster"))


def spectral(edges: DataFrame, k: int, iterations: int = 10) -> DataFrame:
    """(node, cluster) by power iteration clustering; nodes may have any type, they are numbered first."""
    from pyspark.ml.clustering import PowerIterationClustering

    ids = table(numbered(vertices(edges), [F.asc("node")], "id"), "spectral-ids")
    name = lambda c: ids.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
    e = edges.join(name("src"), "src").join(name("dst"), "dst")
    e = e.select(F.least("src_id", "dst_id").alias("src"), F.greatest("src_id", "dst_id").alias("dst"), "weight").filter("src < dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    out = PowerIterationClustering(k=k, maxIter=iterations, weightCol="weight").assignClusters(e)
    return ids.join(out, "id").select("node", "cluster")


def greedy_modularity(edges: DataFrame) -> DataFrame:
    """(node, community): communities are joined as long as that raises modularity; each round, those that are each other's best."""
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("weight").alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    e = table(e, "greedy-edges")
    total = e.agg(F.sum("w")).first()[0] or 1.0
    found = table(vertices(e).withColumn("community", F.col("node")), "greedy")
    while True:
        k = e.select(F.explode(F.array("src", "dst")).alias("c"), "w").groupBy("c").agg((F.sum("w") / (2 * total)).alias("a"))
        at = lambda c: k.select(F.col("c").alias(c), F.col("a").alias(f"{c}_a"))  # noqa: E731,B023
        gain = F.col("w") / total - 2 * F.col("src_a") * F.col("dst_a")
        rises = table(e.filter("src != dst").join(at("src"), "src").join(at("dst"), "dst").withColumn("gain", F.round(gain, 12)).filter("gain > 0").select("src", "dst", "gain"), "greedy-gains")
        ends = rises.select(F.explode(F.array("src", "dst")).alias("c"), F.struct(-F.col("gain"), "src", "dst").alias("x"), F.struct("src", "dst").alias("pair"))
        best = ends.groupBy("c").agg(F.min_by("pair", "x").alias("pair"))
        joined = table(best.groupBy("pair").agg(F.count("*").alias("n")).filter("n = 2").select(F.col("pair.dst").alias("old"), F.col("pair.src").alias("new")), "greedy-joined")
        if joined.isEmpty():
            return found
        to = lambda df, c: df.join(joined.select(F.col("old").alias(c), F.col("new").alias(f"{c}_new")), c, "left").withColumn(c, F.coalesce(f"{c}_new", c)).drop(f"{c}_new")  # noqa: E731,B023
        found = table(to(found, "community").select("node", "community"), "greedy")
        e = to(to(e, "src"), "dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").groupBy("src", "dst").agg(F.sum("w").alias("w"))
        e = table(e, "greedy-edges")


def maximum_flow(edges: DataFrame, source, sink, most_edges: int = 100_000) -> float:
    """Value of the largest flow (Edmonds and Karp): up to most_edges in the driver, beyond by distributed searches."""
    from collections import defaultdict, deque

    summed = table(edges.groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("c")), "flow")
    if summed.count() > most_edges:
        return _distributed_flow(summed, source, sink)
    left: dict = defaultdict(lambda: defaultdict(float))
    for r in summed.collect():
        left[r["src"]][r["dst"]] += r["c"]
        left[r["dst"]][r["src"]] += 0.0
    flow = 0.0
    while True:
        parent, todo = {source: None}, deque([source])
        while todo and sink not in parent:
            u = todo.popleft()
            for v, c in left[u].items():
                if c > 1e-12 and v not in parent:
                    parent[v] = u
                    todo.append(v)
        if sink not in parent:
            return flow
        path, v = [], sink
        while parent[v] is not None:
            path.append((parent[v], v))
            v = parent[v]
        step = min(left[u][v] for u, v in path)
        for u, v in path:
            left[u][v] -= step
            left[v][u] += step
        flow += step


def _distributed_flow(left: DataFrame, source, sink) -> float:
    """The same over a table of what is left (src, dst, c): only the one path of a round comes to the driver."""
    from weft.operators.traverse import bfs_paths

    flow = 0.0
    while True:
        open_ = left.filter(F.col("c") > 1e-12)
        found = bfs_paths(open_, source).filter(F.col("node") == sink).first()
        if found is None:
            return flow
        path = list(zip(found["path"], found["path"][1:], strict=False))
        kind = left.schema["src"].dataType.simpleString()
        on = left.sparkSession.createDataFrame(path, f"src {kind}, dst {kind}")
        step = left.join(F.broadcast(on), ["src", "dst"]).agg(F.min("c")).first()[0]  # as many edges as the path has
        change = on.withColumn("c", F.lit(-step)).unionByName(on.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(step).alias("c")))
        left = table(left.unionByName(change).groupBy("src", "dst").agg(F.sum("c").alias("c")), "flow")
        flow += step


def laplacian_eigenvalues(edges: DataFrame, most_nodes: int = 2_000) -> list[float]:
    """All of a small undirected graph, in order: as many numbers as the square of its nodes are refused beyond most_nodes;
    laplacian_moments() takes any size."""
    import numpy as np

    e = canonical(edges)
    names = [r["node"] for r in e.select(F.explode(F.array("a", "b")).alias("node")).distinct().limit(most_nodes + 1).collect()]
    if len(names) > most_nodes:
        raise ValueError(f"more than {most_nodes} nodes")
    at = {v: i for i, v in enumerate(sorted(names))}
    m = np.zeros((len(at), len(at)))
    for r in e.collect():  # at most the square of the bounded number of nodes
        i, j = at[r["a"]], at[r["b"]]
        m[i, j] = m[j, i] = -1
        m[i, i] += 1
        m[j, j] += 1
    return [float(x) for x in np.linalg.eigvalsh(m)]


def laplacian_moments(edges: DataFrame) -> DataFrame:
    """(nodes, eigenvalue_sum, eigenvalue_squares): of the undirected graph's Laplacian, from its degrees, at any size."""
    e = canonical(edges)
    d = e.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    return d.agg(F.count("*").alias("nodes"), F.sum("d").alias("eigenvalue_sum"), F.sum(F.col("d") * F.col("d") + F.col("d")).alias("eigenvalue_squares"))


def ranked(values: DataFrame, value: str, key: str = "node") -> DataFrame:
    """Centralities with their rank, from 1, the greatest first, then by node."""
    return numbered(values, [F.desc(value), F.asc(key)], "rank")


def summary(edges: DataFrame, sources: DataFrame, time: str | None = None) -> DataFrame:
    """(metric, value): density, average degree, clustering, diameter over sources, components, and growth a period if times are there."""
    d, c = density(edges).first(), global_clustering(edges).first()
    parts = connected_components(edges).agg(F.countDistinct("component")).first()[0]
    rows = [("nodes", float(d["nodes"])), ("edges", float(d["edges"])), ("density", d["density"]), ("average_degree", d["average_degree"]), ("clustering", c["average"]), ("components", float(parts)), ("diameter", float(extent(edges, sources).first()["diameter"]))]
    if time is not None:
        per = edges.groupBy(F.date_trunc("year", F.col(time)).alias("t")).agg(F.count("*").alias("n"))
        ends = per.agg(F.min_by("n", "t").alias("a"), F.max_by("n", "t").alias("z")).first()
        rows.append(("growth", ends["z"] / ends["a"] - 1 if ends["a"] else None))
    return edges.sparkSession.createDataFrame(rows, "metric string, value double")
