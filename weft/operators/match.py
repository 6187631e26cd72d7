"""Subgraph patterns as chains of joins, and what follows a match: scores, duplicates, sets, pages, motifs."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.scalars import jaccard
from weft.operators import cells
from weft.plans.lineage import small, table


@dataclass
class NodeSpec:
    """A pattern's node: an alias, and filters on the node's columns (rows of nodes are only read if there are any)."""

    alias: str
    where: Column | None = None
    min_degree: int | None = None
    max_degree: int | None = None
    direction: str = "both"


@dataclass
class EdgeSpec:
    """A pattern's edge from one alias to another: type, weight range and any further filter."""

    src: str
    dst: str
    type: str | None = None
    min_weight: float | None = None
    max_weight: float | None = None
    where: Column | None = None
    directed: bool = True
    optional: bool = False
    valid_at: object = None
    min_confidence: float | None = None


@dataclass
class Pattern:
    nodes: list[NodeSpec] = field(default_factory=list)
    edges: list[EdgeSpec] = field(default_factory=list)
    injective: bool = True


def _candidates(edges: DataFrame, e: EdgeSpec) -> DataFrame:
    parts = []
    if e.type is not None:
        parts.append(F.col("type") == e.type)
    if e.min_weight is not None:
        parts.append(F.col("weight") >= e.min_weight)
    if e.max_weight is not None:
        parts.append(F.col("weight") <= e.max_weight)
    if e.where is not None:
        parts.append(e.where)
    if e.valid_at is not None:
        from weft.operators.temporal import valid_at

        parts.append(valid_at(e.valid_at))
    if e.min_confidence is not None:
        parts.append(F.col("confidence") >= e.min_confidence)
    found = edges.filter(reduce(lambda a, b: a & b, parts)) if parts else edges
    found = found.select("src", "dst", "weight")
    return found if e.directed else found.unionByName(found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def ordered(pattern: Pattern) -> list[EdgeSpec]:
    """Edges so that each shares a node with those before it, the most constrained first, optional ones last."""
    left, out, seen = list(pattern.edges), [], set()
    filtered = {n.alias for n in pattern.nodes if n.where is not None or n.min_degree is not None}
    cost = lambda e: (e.optional, -sum(x is not None for x in (e.type, e.min_weight, e.max_weight, e.where)) - len({e.src, e.dst} & filtered))
    while left:
        near = [e for e in left if not seen or {e.src, e.dst} & seen] or left
        best = min(near, key=cost)
        out.append(best)
        left.remove(best)
        seen |= {best.src, best.dst}
    return out


def product(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """All pairs of rows, or (left) all of a with nulls where b is empty: what a pattern of parts that share nothing asks for.

    The smaller side is broadcast if its size allows; else Spark deals blocks of both.
    """
    if small(b):
        return a.join(F.broadcast(b), F.lit(True), how)
    if how == "inner" and small(a):
        return F.broadcast(a).join(b, F.lit(True))
    return a.join(b, F.lit(True), how)


def degree_between(edges: DataFrame, spec: NodeSpec, rows: DataFrame) -> DataFrame:
    """Rows whose node (alias) has a degree in bounds, counted by direction; a node without edges has degree 0."""
    ends = {"out": F.array("src"), "in": F.array("dst"), "both": F.array("src", "dst")}[spec.direction]
    degree = edges.select(F.explode(ends).alias(spec.alias)).groupBy(spec.alias).agg(F.count("*").alias("_d"))
    low, high = spec.min_degree or 0, 2**62 if spec.max_degree is None else spec.max_degree
    return rows.join(degree, spec.alias, "left").filter(F.coalesce("_d", F.lit(0)).between(low, high)).drop("_d")


def match(edges: DataFrame, pattern: Pattern, nodes: DataFrame | None = None, sources: dict[str, DataFrame] | None = None) -> DataFrame:
    """A column for each alias and w1, w2, ... for the edges' weights, in the pattern's order of edges.

    sources: edges by type, where each type has a view of its own, so that only what the pattern asks for is scanned.
    Nodes that no edge names are bound to all nodes that their filters keep.
    """
    numbers = {id(e): i + 1 for i, e in enumerate(pattern.edges)}
    filters = {n.alias: n for n in pattern.nodes if nodes is not None and n.where is not None}
    out: DataFrame | None = None
    bound: list[str] = []
    for e in ordered(pattern):
        given = (sources or {}).get(e.type or "", edges)
        step = _candidates(given, e).select(F.col("src").alias(e.src), F.col("dst").alias(e.dst), F.col("weight").alias(f"w{numbers[id(e)]}")) if e.src != e.dst else _candidates(given, e).filter("src = dst").select(F.col("src").alias(e.src), F.col("weight").alias(f"w{numbers[id(e)]}"))
        for a in dict.fromkeys((e.src, e.dst)):
            if a in filters and a not in bound:
                step = step.join(nodes.filter(filters[a].where).select(F.col("id").alias(a)), a, "left_semi")
        shared = [a for a in dict.fromkeys((e.src, e.dst)) if a in bound]
        fresh = [a for a in dict.fromkeys((e.src, e.dst)) if a not in bound]
        differ = [(a, b) for i, a in enumerate(fresh) for b in [*bound, *fresh[:i]]] if pattern.injective else []
        if out is None:
            out = step
        elif e.optional:  # what must differ belongs to the join: a binding without a fit stays, with nulls
            step = step.withColumnsRenamed({a: f"_{a}" for a in shared})
            met = [F.col(a) == F.col(f"_{a}") for a in shared] + [F.col(a) != F.col(b) for a, b in differ]
            out = out.join(step, reduce(lambda a, b: a & b, met, F.lit(True)), "left").drop(*[f"_{a}" for a in shared])
            differ = []
        else:
            out = out.join(step, shared) if shared else product(out, step)
        for a, b in differ:
            out = out.filter(F.col(a) != F.col(b))
        bound += fresh
    for n in pattern.nodes:
        if n.alias not in bound and nodes is not None:
            alone = (nodes if n.where is None else nodes.filter(n.where)).select(F.col("id").alias(n.alias))
            out = alone if out is None else product(out, alone)
            for b in bound if pattern.injective else []:
                out = out.filter(F.col(n.alias) != F.col(b))
            bound.append(n.alias)
    for n in pattern.nodes:
        if n.min_degree is not None or n.max_degree is not None:
            out = degree_between(edges, n, out)
    return out


def enhanced_score(score: Column, confidence: Column, n_nodes: Column, n_edges: Column, complete: Column) -> Column:
    """1.0 score + 0.5 confidence + 0.2 root of nodes + 0.3 root of edges + 0.1 if complete; 0 at least."""
    total = score + 0.5 * confidence + 0.2 * F.sqrt(n_nodes) + 0.3 * F.sqrt(n_edges) + F.when(complete, 0.1).otherwise(0.0)
    return F.greatest(total, F.lit(0.0))


def top(matches: DataFrame, score: str, ties: list[str], k: int = 1000) -> DataFrame:
    """The k best: one partial top-k a task, then one of all, never a whole sort."""
    return matches.orderBy(F.desc(score), *ties).limit(k)


def cursor_of(score, key) -> str:
    """A page's end as a text to give back: the score and key of its last row."""
    import base64
    import json

    return base64.urlsafe_b64encode(json.dumps([score, key]).encode()).decode()


def connection(rows: DataFrame, score: str, key: str, size: int, cursor: str | None = None) -> DataFrame:
    """A page with total_count and has_next, by score descending, then key; cursor: where the page begins."""
    import base64
    import json

    after = tuple(json.loads(base64.urlsafe_b64decode(cursor))) if cursor else None
    n = rows.count()
    page = table(page_after(rows, score, key, after, size + 1), "page")
    more = page.count() > size
    shown = top(page, score, [key], size)
    return shown.withColumns({"total_count": F.lit(n).cast("long"), "has_next": F.lit(more)})


def page_after(rows: DataFrame, score: str, key: str, after: tuple | None, size: int) -> DataFrame:
    """The next page of rows by score descending, then key; after: the last page's last (score, key)."""
    if after is not None:
        s, k = after
        rows = rows.filter((F.col(score) < s) | ((F.col(score) == s) & (F.col(key) > k)))
    return top(rows, score, [key], size)


def filtered(matches: DataFrame, **bounds: tuple) -> DataFrame:
    """Matches whose columns lie within bounds, name=(low, high), both inclusive, either None."""
    for c, (low, high) in bounds.items():
        matches = matches if low is None else matches.filter(F.col(c) >= low)
        matches = matches if high is None else matches.filter(F.col(c) <= high)
    return matches


def shares_binding(a: DataFrame, b: DataFrame, aliases: list[str], keep: bool) -> DataFrame:
    """Rows of a that bind some alias to the same node as some row of b (keep), or those that don't.

    One semi or anti join for each alias instead of a join on any of them, which would compare all pairs.
    """
    if not keep:
        for x in aliases:
            a = a.join(b.select(x).distinct(), x, "left_anti")
        return a
    parts = []
    for i, x in enumerate(aliases):
        rest = a
        for y in aliases[:i]:
            rest = rest.join(b.select(y).distinct(), y, "left_anti")
        parts.append(rest.join(b.select(x).distinct(), x, "left_semi").select(*a.columns))
    return reduce(DataFrame.unionByName, parts)


def without_similar(matches: DataFrame, aliases: list[str], score: str, least: float = 0.8) -> DataFrame:
    """Of all matches, those not similar to a better one that is kept.

    Similarity is the share of aliases bound alike; the order is score descending, then aliases. Similar matches are those
    alike in some set of as many aliases as that takes, so no pairs are made: in rounds, those that are the best in all of
    their groups by such a set stay, and all others in these groups go.
    """
    need = next((n for n in range(1, len(aliases) + 1) if n >= least * len(aliases)), None)
    if need is None:
        return matches
    numbered = table(matches.withColumn("_row", F.monotonically_increasing_id()), "matches")
    order = F.struct(F.col(score).isNull().alias("none"), (-F.col(score)).alias("down"), *aliases, "_row")
    groups = [F.when(reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in c]), F.struct(F.lit(i).alias("k"), F.array(*[F.col(x).cast("string") for x in c]).alias("v"))) for i, c in enumerate(combinations(aliases, need))]
    rest = table(numbered.select("_row", order.alias("_order"), F.array_compact(F.array(*groups)).alias("_groups")), "rest")
    kept = []
    while not rest.isEmpty():
        each = rest.select("_row", "_order", F.explode("_groups").alias("g"))
        best = each.groupBy("g").agg(F.min("_order").alias("_best"))
        beaten = each.join(best, "g").filter(F.col("_order") != F.col("_best")).select("_row").distinct()
        stay = table(rest.join(beaten, "_row", "left_anti"), "stay")
        taken = stay.select(F.explode("_groups").alias("g")).distinct()
        gone = each.join(taken, "g", "left_semi").select("_row").unionByName(stay.select("_row")).distinct()
        rest = table(rest.join(gone, "_row", "left_anti"), "rest")
        kept.append(stay.select("_row"))
    if not kept:
        return matches
    return numbered.join(reduce(DataFrame.unionByName, kept), "_row", "left_semi").drop("_row")


def binding_similarity(a: Column, b: Column) -> Column:
    """Of two maps of bindings: the mean of the keys' Jaccard similarity and the share of common keys bound alike."""
    common = F.array_intersect(F.map_keys(a), F.map_keys(b))
    equal = F.size(F.filter(common, lambda k: F.element_at(a, k) == F.element_at(b, k)))
    return (jaccard(F.map_keys(a), F.map_keys(b)) + F.coalesce(equal / F.nullif(F.size(common), F.lit(0)), F.lit(0.0))) / 2


def fuzzy(rows: DataFrame, conditions: list[Column], least: float = 0.8) -> DataFrame:
    """Rows with the share of soft conditions that they meet, where it is large enough."""
    met = sum((F.coalesce(c, F.lit(False)).cast("int") for c in conditions), F.lit(0))
    return rows.withColumn("match_score", met / F.lit(len(conditions))).filter(F.col("match_score") >= least)


def canonical(edges: DataFrame) -> DataFrame:
    """(a, b): each undirected edge once, a < b, without loops."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a < b").distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c: paths from the end of lower degree, closed by an edge, found in cells: paths are not shuffled."""
    return cells.triangles(edges)


def wedge_counts(edges: DataFrame) -> DataFrame:
    """(node, wedges): paths of two edges with the node in the middle, from its degree alone."""
    e = canonical(edges)
    degree = e.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    return degree.select("node", (F.col("d") * (F.col("d") - 1) / 2).cast("long").alias("wedges"))


def color_classes(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(color, n) after some rounds of colour refinement: graphs whose tables differ are not isomorphic."""
    e = canonical(edges)
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    colors = e.select(F.col("a").alias("node")).distinct().withColumn("color", F.lit(0).cast("long"))
    for _ in range(rounds):
        seen = e.join(colors.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.sort_array(F.collect_list("color")).alias("near"))
        colors = colors.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.xxhash64("color", "near").alias("color"))
    return colors.groupBy("color").agg(F.count("*").alias("n"))


def motifs(edges: DataFrame, size: int) -> DataFrame:
    """(kind, n) of connected induced motifs of 3 or 4 nodes.

    Of 4: counts of what is there with or without more edges, from degrees, triangles at nodes and edges, and common
    neighbours, are solved for the six kinds.
    """
    if size not in (3, 4):
        raise ValueError("motifs of three or four nodes are counted; larger ones are patterns for match()")
    one = lambda df, c: int(df.agg(F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)")).first()[0])
    ways = cells.oriented_cells(edges)
    d, t, x = ways.degree, one(ways.run(cells.wholes, "n long"), "n"), F.col("j")
    if size == 3:
        rows = [("triangle", t), ("wedge", one(d, (x * (x - 1) / 2).cast("long")) - 3 * t)]
        return edges.sparkSession.createDataFrame(rows, "kind string, n long")
    stars = one(d, (x * (x - 1) * (x - 2) / 6).cast("long"))
    paths = one(ways.run(cells.paths, "n long"), "n") - 3 * t
    sums = table(ways.run(cells.quads, "every long, edges long, paws long"), "quads")
    cycles, diamonds, paws = one(sums, "every") // 2, one(sums, "edges"), one(sums, "paws") // 2
    cliques = one(ways.run(cells.cliques, "n long"), "n")
    diamond = diamonds - 6 * cliques
    cycle = cycles - diamond - 3 * cliques
    paw = paws - 4 * diamond - 12 * cliques
    star = stars - paw - 2 * diamond - 4 * cliques
    path = paths - 4 * cycle - 2 * paw - 6 * diamond - 12 * cliques
    rows = [("clique", cliques), ("diamond", diamond), ("cycle", cycle), ("paw", paw), ("star", star), ("path", path)]
    return edges.sparkSession.createDataFrame(rows, "kind string, n long")


def refined(edges: DataFrame, colors: DataFrame, rounds: int) -> DataFrame:
    """(node, color) after some rounds in which a colour takes in those of the neighbours, or until no class is parted any more."""
    e = canonical(edges)
    e = table(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))), "iso-edges")
    n = colors.select("color").distinct().count()
    for _ in range(rounds):
        near = e.join(colors.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.sort_array(F.collect_list("color")).alias("near"))
        colors = table(colors.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.xxhash64("color", "near").alias("color")), "iso-colors")
        now = colors.select("color").distinct().count()
        if now == n:
            break
        n = now
    return colors


def isomorphic(a: DataFrame, b: DataFrame, rounds: int = 1_000_000) -> bool:
    """Whether two undirected simple graphs are the same but for their nodes' names.

    Colours are refined in both alike. Where all classes have one node the edges are compared by colour; else a node of the
    smallest other class is given a colour of its own, and each of its partners in turn.
    """
    start = lambda g: canonical(g).select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("color", F.lit(0).cast("long"))

    def same(x: DataFrame, y: DataFrame) -> bool:
        x, y = refined(a, x, rounds), refined(b, y, rounds)
        count = lambda c: c.groupBy("color").agg(F.count("*").alias("n"))
        classes = table(count(x), "iso-classes")
        if not classes.exceptAll(count(y)).isEmpty() or not count(y).exceptAll(classes).isEmpty():
            return False
        split = classes.filter("n > 1").orderBy("n", "color").first()
        if split is None:
            by = lambda g, c: canonical(g).join(c.select(F.col("node").alias("a"), F.col("color").alias("x")), "a").join(c.select(F.col("node").alias("b"), F.col("color").alias("y")), "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
            return by(a, x).exceptAll(by(b, y)).isEmpty() and by(b, y).exceptAll(by(a, x)).isEmpty()
        own = lambda c, v: c.withColumn("color", F.when(F.col("node") == v, F.xxhash64("color", F.lit("own"))).otherwise(F.col("color")))
        one = x.filter(F.col("color") == split["color"]).agg(F.min("node")).first()[0]
        partners = [r["node"] for r in y.filter(F.col("color") == split["color"]).orderBy("node").collect()]  # of the smallest class
        return any(same(own(x, one), own(y, v)) for v in partners)

    if canonical(a).count() != canonical(b).count():
        return False
    return same(start(a), start(b))


def all_different(aliases: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a) != F.col(b) for a, b in combinations(aliases, 2)], F.lit(True))
