"""Traversals and paths: loops of joins over a frontier, each step's result written so that plans stay short.

Edges are (src, dst) and, where weights count, weight. direction: out, in or both. Depths include the last one; None goes
on until nothing new is reached.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.aggregate import numbered
from weft.plans.lineage import broadcast_if_small, table


def directed(edges: DataFrame, direction: str = "out", weighted: bool = False) -> DataFrame:
    """(src, dst[, weight]) in the direction of travel; the lightest of parallel edges."""
    more = ["weight"] if weighted else []
    out = edges.select("src", "dst", *more)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *more)
    e = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return e.groupBy("src", "dst").agg(F.min("weight").alias("weight")) if weighted else e.distinct()


def _steps(most: int | None):
    return count(1) if most is None else range(1, most + 1)


def bfs(edges: DataFrame, sources: DataFrame, max_depth: int | None = None, direction: str = "out", where: DataFrame | None = None, kinds: list[str] | None = None, max_results: int | None = None) -> DataFrame:
    """(node, depth) of all that is reached from sources (node) in 0 to max_depth steps, over nodes of where (node) and edges of
    some types only; of max_results nodes at most, those by depth and then node."""
    if kinds is not None:
        edges = edges.filter(F.col("type").isin(kinds))
    e = table(directed(edges, direction), "bfs-edges")
    seen = table(sources.select("node").distinct().withColumn("depth", F.lit(0)), "bfs")
    front = seen
    for depth in _steps(max_depth):
        step = e.join(broadcast_if_small(front.select(F.col("node").alias("src"))), "src").select(F.col("dst").alias("node")).distinct()
        if where is not None:
            step = step.join(where.select("node"), "node", "left_semi")
        front = table(step.join(broadcast_if_small(seen.select("node")), "node", "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen if max_results is None else seen.orderBy("depth", "node").limit(max_results)


def bfs_paths(edges: DataFrame, source, max_depth: int | None = None, direction: str = "out", kinds: list[str] | None = None) -> DataFrame:
    """(node, depth, path): a shortest path to each node that is reached, the least of them."""
    if kinds is not None:
        edges = edges.filter(F.col("type").isin(kinds))
    e = table(directed(edges, direction), "bfs-edges")
    front = table(edges.sparkSession.range(1).select(F.lit(source).alias("node"), F.lit(0).alias("depth"), F.array(F.lit(source)).alias("path")), "paths")
    seen = front
    for depth in _steps(max_depth):
        step = e.join(broadcast_if_small(front.withColumnRenamed("node", "src").select("src", "path")), "src").select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        step = step.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        front = table(step.select("node", F.lit(depth).alias("depth"), "path"), "paths")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def dfs(edges: DataFrame, source, max_depth: int = 10, direction: str = "out", max_results: int | None = None) -> DataFrame:
    """(node, depth, nth): nodes in the order of a depth-first search with a stack, neighbours least first, to max_depth edges.

    What a branch has visited is not visited again, also where another branch would reach it in fewer steps, so the order is
    one sequence: one task walks it, over the edges that are within max_depth steps.
    """
    ball = table(bfs(edges, edges.sparkSession.range(1).select(F.lit(source).alias("node")), max_depth, direction), "ball")
    near = directed(edges, direction).join(broadcast_if_small(ball.select(F.col("node").alias("src"))), "src", "left_semi")
    kind = ball.schema["node"].dataType.simpleString()
    start = ball.filter("depth = 0").select(F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst"))

    def walk(group):
        import pyarrow as pa

        after: dict = {}
        for a, b in zip(group.column("src").to_pylist(), group.column("dst").to_pylist(), strict=True):
            if b is not None:
                after.setdefault(a, []).append(b)
        at = next(a for a, b in zip(group.column("src").to_pylist(), group.column("dst").to_pylist(), strict=True) if b is None)
        seen, rows, stack = set(), [], [(at, 0)]
        while stack and (max_results is None or len(rows) < max_results):
            node, depth = stack.pop()
            if node in seen:
                continue
            seen.add(node)
            rows.append((node, depth, len(rows)))
            if depth < max_depth:
                stack += [(x, depth + 1) for x in sorted(after.get(node, []), reverse=True) if x not in seen]
        return pa.table({n: pa.array(c, group.schema.field("src").type if n == "node" else pa.int64()) for n, c in zip(("node", "depth", "nth"), zip(*rows, strict=True), strict=True)})

    return near.select("src", "dst").unionByName(start).withColumn("g", F.lit(0)).groupBy("g").applyInArrow(walk, f"node {kind}, depth long, nth long")


def k_hop(edges: DataFrame, source, k: int, direction: str = "out", kinds: list[str] | None = None, paths: bool = False) -> DataFrame:
    """(node, depth) within k steps, without the source; with paths also a path to each."""
    if paths:
        return bfs_paths(edges, source, k, direction, kinds).filter(F.col("depth") > 0)
    start = edges.sparkSession.range(1).select(F.lit(source).alias("node"))
    return bfs(edges, start, k, direction, kinds=kinds).filter(F.col("depth") > 0)


def multi_bfs(edges: DataFrame, sources: DataFrame, max_depth: int | None = None, direction: str = "out") -> DataFrame:
    """(source, node, depth) for every source (node) at once."""
    e = table(directed(edges, direction), "bfs-edges")
    seen = table(sources.select(F.col("node").alias("source"), "node").distinct().withColumn("depth", F.lit(0)), "bfs")
    front = seen
    for depth in _steps(max_depth):
        step = front.select("source", F.col("node").alias("src")).join(e, "src").select("source", F.col("dst").alias("node")).distinct()
        front = table(step.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_distances(edges: DataFrame, sources: DataFrame, direction: str = "out", max_hops: int | None = None, max_distance: float | None = None, weight: Column | None = None) -> DataFrame:
    """(source, node, distance) by relaxing edges from what got nearer in the step before, until nothing does; weights are not
    negative. weight: any column of the edges instead of their weight."""
    if weight is not None:
        edges = edges.withColumn("weight", weight.cast("double"))
    e = table(directed(edges, direction, weighted=True), "relax-edges")
    best = table(sources.select(F.col("node").alias("source"), "node").distinct().withColumn("distance", F.lit(0.0)), "relax")
    front = best
    for _ in _steps(max_hops):
        step = front.withColumnRenamed("node", "src").join(e, "src").select("source", F.col("dst").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"))
        if max_distance is not None:
            step = step.filter(F.col("distance") <= max_distance)
        step = step.groupBy("source", "node").agg(F.min("distance").alias("distance"))
        known = best.withColumnRenamed("distance", "known")
        front = table(step.join(known, ["source", "node"], "left").filter(F.col("known").isNull() | (F.col("distance") < F.col("known"))).drop("known"), "relax")
        if front.isEmpty():
            break
        best = table(best.unionByName(front).groupBy("source", "node").agg(F.min("distance").alias("distance")), "relax")
    return best


def a_star(edges: DataFrame, source, target, heuristic: DataFrame | None = None, direction: str = "out") -> DataFrame:
    """(path, distance): a lightest path, the least of them. heuristic: (node, h), at most what is left to the target, else 0.

    What got nearer is only followed where distance and heuristic are not above the best distance to the target so far.
    """
    spark = edges.sparkSession
    e = table(directed(edges, direction, weighted=True), "relax-edges")
    best = front = table(spark.range(1).select(F.lit(source).alias("node"), F.lit(0.0).alias("distance"), F.array(F.lit(source)).alias("path")), "a-star")
    bound = float("inf")
    while not front.isEmpty():
        step = front.withColumnRenamed("node", "src").join(e, "src").select(F.col("dst").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"), F.array_append("path", F.col("dst")).alias("path"))
        step = step.groupBy("node").agg(F.min(F.struct("distance", "path")).alias("x")).select("node", "x.*")
        if heuristic is not None:
            step = step.join(heuristic, "node", "left").filter(F.col("distance") + F.coalesce("h", F.lit(0.0)) <= bound).drop("h")
        step = step.filter(F.col("distance") <= bound)
        known = best.select("node", F.struct("distance", "path").alias("known"))
        front = table(step.join(known, "node", "left").filter(F.col("known").isNull() | (F.struct("distance", "path") < F.col("known"))).drop("known"), "a-star")
        best = table(best.unionByName(front).groupBy("node").agg(F.min(F.struct("distance", "path")).alias("x")).select("node", "x.*"), "a-star")
        there = best.filter(F.col("node") == target).first()
        bound = there["distance"] if there else bound
    return best.filter(F.col("node") == target).select("path", "distance")


def all_shortest_paths(edges: DataFrame, source, target, max_depth: int = 5, direction: str = "both") -> DataFrame:
    """(path, length) of all paths with the fewest edges."""
    e = table(directed(edges, direction), "path-edges")
    paths = edges.sparkSession.range(1).select(F.array(F.lit(source)).alias("path"), F.lit(source).alias("node"))
    near = table(bfs(edges, e.sparkSession.range(1).select(F.lit(target).alias("node")), max_depth, {"out": "in", "in": "out", "both": "both"}[direction]), "near")
    found = near.filter(F.col("node") == source).first()
    if found is None:
        return paths.limit(0).select("path", F.lit(0).alias("length"))
    for left in range(found["depth"] - 1, -1, -1):  # only over nodes that are one step nearer to the target
        step = near.filter(F.col("depth") == left).select("node")
        paths = paths.withColumnRenamed("node", "src").join(e.withColumnRenamed("dst", "node"), "src").join(broadcast_if_small(step), "node", "left_semi").select(F.array_append("path", F.col("node")).alias("path"), "node")
    return paths.select("path", F.lit(found["depth"]).alias("length"))


def simple_paths(edges: DataFrame, source, target, max_depth: int, direction: str = "out", limit: int | None = None, lightest: tuple[DataFrame, float] | None = None) -> DataFrame:
    """(path, length, weight) of paths without repeated nodes, of at most max_depth edges; only over nodes that can reach the target in time.

    lightest: (node, distance to the target) and the weight up to which paths are wanted: only what can stay below is followed.
    """
    e = directed(edges, direction, weighted="weight" in edges.columns)
    e = table(e if "weight" in e.columns else e.withColumn("weight", F.lit(1.0)), "path-edges")
    back = table(bfs(edges, e.sparkSession.range(1).select(F.lit(target).alias("node")), max_depth, {"out": "in", "in": "out", "both": "both"}[direction]), "near")
    near = broadcast_if_small(back.withColumnRenamed("depth", "left"))
    now = e.sparkSession.range(1).select(F.array(F.lit(source)).alias("path"), F.lit(source).alias("src"), F.lit(0.0).alias("total"))
    done = None
    for depth in range(1, max_depth + 1):
        step = now.join(e, "src").filter(~F.array_contains("path", F.col("dst"))).join(near, F.col("dst") == F.col("node")).filter(F.col("left") <= max_depth - depth)
        step = step.select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("src"), (F.col("total") + F.col("weight")).alias("total"))
        if lightest is not None:
            rest, most = lightest
            step = step.join(broadcast_if_small(rest.select(F.col("node").alias("src"), F.col("distance").alias("rest"))), "src").filter(F.col("total") + F.col("rest") <= most).drop("rest")
        step = table(step.select("path", "src", "total"), "paths")
        here = step.filter(F.col("src") == target).select("path", F.lit(depth).alias("length"), F.col("total").alias("weight"))
        done = here if done is None else done.unionByName(here)
        now = step.filter(F.col("src") != target)
    out = done.orderBy("length", "path")
    return out if limit is None else out.limit(limit)


def k_shortest(edges: DataFrame, source, target, k: int, max_depth: int = 6, direction: str = "out") -> DataFrame:
    """The k lightest simple paths of at most max_depth edges, with rank.

    Distances to the target say what a beginning of a path can still weigh at least, so only paths up to a weight are put
    together; the weight grows until k are found, or all.
    """
    back = {"out": "in", "in": "out", "both": "both"}[direction]
    rest = table(shortest_distances(edges, edges.sparkSession.range(1).select(F.lit(target).alias("node")), back, max_depth).select("node", "distance"), "rest")
    first = rest.filter(F.col("node") == source).first()
    all_weights = directed(edges, direction, weighted=True).agg(F.max("weight")).first()[0] or 0.0
    most, whole = (first["distance"] if first else 0.0), all_weights * max_depth
    while True:
        found = table(simple_paths(edges, source, target, max_depth, direction, lightest=(rest, most)), "k-paths")
        if most >= whole or found.count() >= k:
            break
        most = max(most * 1.5, most + all_weights / 4)
    best = found.orderBy("weight", "path").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("weight", "path")))  # of k rows


def bidirectional(edges: DataFrame, source, target, max_depth: int = 10) -> int | None:
    """Edges on the shortest directed path, from two frontiers that meet half way; None beyond max_depth."""
    spark = edges.sparkSession
    e = {"out": table(directed(edges, "out"), "bfs-edges"), "in": table(directed(edges, "in"), "bfs-edges")}
    one = lambda v: table(spark.range(1).select(F.lit(v).alias("node")), "bfs")
    seen = {"out": one(source), "in": one(target)}
    front, depth = dict(seen), 0
    while depth <= max_depth:
        if not seen["out"].join(seen["in"], "node").isEmpty():
            return depth
        side = "out" if front["out"].count() <= front["in"].count() else "in"
        step = e[side].join(front[side].withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
        front[side] = table(step.join(seen[side], "node", "left_anti"), "bfs")
        if front[side].isEmpty():
            return None
        seen[side], depth = seen[side].unionByName(front[side]), depth + 1
    return None


def random_walks(edges: DataFrame, starts: DataFrame, steps: int, seed: int = 7, restart: float = 0.0, weighted: bool = False) -> DataFrame:
    """(walk, step, node): a seeded walk from each of starts (node); at dead ends, and at times if restart > 0, back to it.

    What a step takes depends on the seed, the walk and the step alone, so runs agree. Edges are numbered in one order of
    all, so a node's edges are a range, and a step is a draw in it and a join on the number: no node's neighbours are
    gathered. With weights, of each block of edges, then within it, by sums of weights.
    """
    e = directed(edges, "out", weighted=True) if weighted else directed(edges, "out").withColumn("weight", F.lit(1.0))
    e = table(numbered(e, [F.asc("src"), F.asc("dst")], "at"), "walk-edges")
    size = 256
    e = e.withColumn("block", F.floor(F.col("at") / size))
    blocks = e.groupBy("src", "block").agg(F.sum("weight").alias("w"), F.min("at").alias("low"), F.count("*").alias("n"))
    nodes = table(blocks.groupBy("src").agg(F.sum("w").alias("all"), F.min("low").alias("low"), F.sum("n").alias("n")), "walk-nodes")
    if weighted:
        order = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = table(blocks.withColumn("from", F.coalesce(F.sum("w").over(order), F.lit(0.0))), "walk-blocks")  # a row for 256 edges
        inner = Window.partitionBy("src", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        e = table(e.withColumn("from", F.coalesce(F.sum("weight").over(inner), F.lit(0.0))), "walk-edges")
    now = table(starts.select(F.col("node").alias("walk"), "node"), "walk")
    out = now.withColumn("step", F.lit(0))
    draw = lambda step, what: F.pmod(F.xxhash64(F.lit(f"{seed}:{step}:{what}"), F.col("walk")), F.lit(1 << 30)) / float(1 << 30)
    for step in range(1, steps + 1):
        met = now.withColumn("u", draw(step, "edge")).join(nodes.withColumnRenamed("src", "node"), "node", "left")
        if weighted:
            met = met.withColumn("x", F.col("u") * F.col("all")).drop("low", "n")
            b = blocks.select(F.col("src").alias("node"), F.col("block"), F.col("from").alias("b_from"), F.col("w").alias("b_w"))
            met = met.join(b, "node", "left").filter(F.col("block").isNull() | ((F.col("x") >= F.col("b_from")) & (F.col("x") < F.col("b_from") + F.col("b_w"))))
            met = met.withColumn("x", F.col("x") - F.col("b_from"))
            inside = e.select(F.col("src").alias("node"), "block", "dst", "from", "weight")
            met = met.join(inside, ["node", "block"], "left").filter(F.col("dst").isNull() | ((F.col("x") >= F.col("from")) & (F.col("x") < F.col("from") + F.col("weight"))))
        else:
            met = met.withColumn("at", F.col("low") + F.floor(F.col("u") * F.col("n"))).join(e.select("at", "dst"), "at", "left")
        to = F.when(draw(step, "restart") < restart, F.col("walk")).otherwise(F.coalesce("dst", "walk"))
        now = table(met.select("walk", to.alias("node")), "walk")
        out = out.unionByName(now.withColumn("step", F.lit(step)))
    return out


def topological_layers(edges: DataFrame) -> tuple[DataFrame, bool]:
    """(node, layer) by peeling nodes without incoming edges, and whether a cycle is left."""
    e = table(directed(edges), "topo-edges")
    left = table(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "topo")
    out, layer = None, 0
    while not left.isEmpty():
        free = table(left.join(e.select(F.col("dst").alias("node")), "node", "left_anti"), "topo")
        if free.isEmpty():
            break
        here = free.withColumn("layer", F.lit(layer))
        out = here if out is None else out.unionByName(here)
        left = table(left.join(free, "node", "left_anti"), "topo")
        e = table(e.join(free.withColumnRenamed("node", "src"), "src", "left_anti"), "topo-edges")
        layer += 1
    if out is None:
        out = left.limit(0).withColumn("layer", F.lit(0))
    return out, not left.isEmpty()


def hierarchy_levels(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth) below the roots, which nothing points to."""
    roots = edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    return bfs(edges, roots, max_depth)


def spreading_activation(edges: DataFrame, seeds: DataFrame, steps: int, decay: float = 0.5) -> DataFrame:
    """(node, activation): seeds (node, activation) send a decayed share along their edges, step by step, added up."""
    e = table(directed(edges), "spread-edges")
    degree = e.groupBy("src").agg(F.count("*").alias("d"))
    e = table(e.join(degree, "src"), "spread-edges")
    now, out = seeds, seeds
    for _ in range(steps):
        sent = now.withColumnRenamed("node", "src").join(e, "src").groupBy(F.col("dst").alias("node")).agg((F.sum(F.col("activation") / F.col("d")) * decay).alias("activation"))
        now = table(sent, "spread")
        out = out.unionByName(now)
    return out.groupBy("node").agg(F.sum("activation").alias("activation"))


def dispatch(edges: DataFrame, source, algorithm: str = "bfs", max_depth: int = 3, where: Column | None = None) -> DataFrame:
    """One of bfs, dfs and dijkstra from a source."""
    if where is not None:
        edges = edges.filter(where)
    start = edges.sparkSession.range(1).select(F.lit(source).alias("node"))
    if algorithm == "dijkstra":
        return shortest_distances(edges, start, max_hops=max_depth).drop("source")
    return dfs(edges, source, max_depth) if algorithm == "dfs" else bfs(edges, start, max_depth)
