"""Graph operators against plain versions on small graphs."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from weft.operators import analytics as N
from weft.operators import hyper as H
from weft.operators import match as M
from weft.operators import reify as R
from weft.operators import scan as C
from weft.operators import traverse as V
from weft.plans.builder import GraphQuery, Script, reified_statement
from weft.sources.tables import Graph

SCHEMA = "src long, dst long, weight double"


def random_edges(seed: int, n: int = 14, m: int = 26) -> list[tuple[int, int, float]]:
    r = random.Random(seed)
    return list({(a, b): (a, b, float(r.randint(1, 9))) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a != b}.values())


def distances(edges, directed=True):
    near = defaultdict(set)
    for a, b, _ in edges:
        near[a].add(b)
        if not directed:
            near[b].add(a)
    out = {}
    for s in {x for e in edges for x in e[:2]}:
        d, todo = {s: 0}, deque([s])
        while todo:
            u = todo.popleft()
            for v in near[u]:
                if v not in d:
                    d[v] = d[u] + 1
                    todo.append(v)
        out[s] = d
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_and_centralities(spark, seed):
    edges = random_edges(seed)
    e = spark.createDataFrame(edges, SCHEMA)
    d = distances(edges)
    nodes = sorted(d)
    assert rows_of(V.multi_bfs(e, N.vertices(e), 30)) == sorted(((s, v, k) for s in d for v, k in d[s].items()), key=repr)
    s, t = nodes[0], nodes[-1]
    assert V.bidirectional(e, s, t) == d[s].get(t)
    # Brandes against all shortest paths.
    paths = {(a, b): [] for a in nodes for b in nodes if a != b and b in d[a]}
    near = defaultdict(list)
    for a, b, _ in edges:
        near[a].append(b)

    def walk(path, b):
        if path[-1] == b:
            paths[path[0], b].append(path)
        else:
            for v in near[path[-1]]:
                if b in d[v] and d[path[0]].get(v) == len(path) and d[v][b] == d[path[0]][b] - len(path):
                    walk([*path, v], b)

    for a, b in paths:
        walk([a], b)
    want = {v: sum(sum(v in p[1:-1] for p in ps) / len(ps) for ps in paths.values()) for v in nodes}
    assert {r["node"]: round(r["betweenness"], 9) for r in N.betweenness(e, N.vertices(e)).collect()} == {v: round(x, 9) for v, x in want.items()}
    # Components.
    strong = {v: min(u for u in nodes if u in d[v] and v in d[u]) for v in nodes}
    assert dict(rows_of(N.strong_components(e))) == strong
    weak = distances(edges, directed=False)
    assert dict(rows_of(N.connected_components(e))) == {v: min(weak[v]) for v in nodes}
    # Shortest weighted paths and trees.
    best = {}
    for s in nodes:
        dist = {s: 0.0}
        for _ in nodes:
            for a, b, w in edges:
                if a in dist and dist[a] + w < dist.get(b, 1e9):
                    dist[b] = dist[a] + w
        best |= {(s, v): x for v, x in dist.items()}
    assert {(r["source"], r["node"]): r["distance"] for r in V.shortest_distances(e, N.vertices(e)).collect()} == best
    parent = {v: v for v in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    total = 0.0
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            total += w
    forest = N.spanning_forest(e).collect()
    assert sum(r["weight"] for r in forest) == total and len(forest) == len(nodes) - len({find(v) for v in nodes})


def test_ranks_sum_and_triangles(spark):
    edges = random_edges(3)
    e = C.both_ways(spark.createDataFrame(edges, SCHEMA))
    assert abs(sum(r["rank"] for r in N.pagerank(e).collect()) - 1) < 1e-4
    pairs = {(min(a, b), max(a, b)) for a, b, _ in edges}
    nodes = {x for p in pairs for x in p}
    want = sorted(t for t in itertools.combinations(sorted(nodes), 3) if all(p in pairs for p in itertools.combinations(t, 2)))
    assert rows_of(M.triangles(e)) == sorted(want, key=repr)
    assert abs(sum(r["value"] ** 2 for r in N.eigenvector(e, 30).collect()) - 1) < 1e-9
    relabelled = spark.createDataFrame([(100 - a, 100 - b, w) for a, b, w in edges], SCHEMA)
    assert rows_of(M.color_classes(e)) == rows_of(M.color_classes(relabelled))


def test_communities_and_flow(spark):
    cliques = [(a, b, 1.0) for base in (0, 10, 20) for a, b in itertools.combinations(range(base, base + 5), 2)] + [(0, 10, 1.0), (10, 20, 1.0)]
    e = spark.createDataFrame(cliques, SCHEMA)
    found = {r["node"]: r["community"] for r in N.louvain(e).collect()}
    assert all(len({found[v] for v in range(b, b + 5)}) == 1 for b in (0, 10, 20)) and len(set(found.values())) == 3
    assert N.modularity(e, N.louvain(e)) > 0.5
    labels = {r["node"]: r["label"] for r in N.label_propagation(e, 8).collect()}
    assert len({labels[v] for v in range(21, 25)}) == 1
    flow = spark.createDataFrame([(0, 1, 3.0), (0, 2, 2.0), (1, 2, 5.0), (1, 3, 2.0), (2, 3, 3.0)], SCHEMA)
    assert N.maximum_flow(flow, 0, 3) == 5.0
    values = N.laplacian_eigenvalues(spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], SCHEMA))
    assert [round(x, 6) for x in values] == [0.0, 1.0, 3.0]
    assert {r["cluster"] for r in N.spectral(e, 3).collect()} <= {0, 1, 2}


def test_communities_of_named_nodes(spark):
    cliques = [(f"n{a:02d}", f"n{b:02d}", 1.0) for base in (0, 10) for a, b in itertools.combinations(range(base, base + 5), 2)] + [("n00", "n10", 1.0)]
    e = spark.createDataFrame(cliques, "src string, dst string, weight double")
    for found in (N.louvain(e), N.greedy_modularity(e), N.label_propagation(e, 8).withColumnRenamed("label", "community")):
        at = {r["node"]: r["community"] for r in found.collect()}
        assert len({at[f"n{i:02d}"] for i in range(1, 5)}) == 1 and len({at[f"n{i:02d}"] for i in range(11, 15)}) == 1 and at["n01"] != at["n11"]
    assert N.spectral(e, 2).count() == 10


def test_long_chains(spark):
    chain = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    start = spark.range(1).select(F.col("id").alias("node"))
    assert N.eccentricities(chain, start).first()["eccentricity"] == 60
    assert V.shortest_distances(chain, start).agg(F.max("distance")).first()[0] == 60.0
    assert N.strong_components(chain.unionByName(chain.limit(0))).count() == 61


def test_strong_components_need_no_cap(spark):
    # five rings on a string: the rest of a part falls into other parts, round after round
    rings = [(5 * k + i, 5 * k + (i + 1) % 5) for k in range(5) for i in range(5)] + [(5 * k, 5 * k + 5) for k in range(4)]
    got = dict(rows_of(N.strong_components(spark.createDataFrame(rings, "src long, dst long"))))
    assert got == {v: v // 5 * 5 for v in range(25)}


def test_large_hyperedges_are_dealt_to_blocks(spark):
    m = spark.range(2_000).select(F.lit(1).cast("long").alias("hid"), F.col("id").alias("node")).unionByName(spark.createDataFrame([(2, 1), (2, 7)], "hid long, node long"))
    pairs = H.co_members(m)
    assert pairs.count() == 2_000 * 1_999 // 2 and rows_of(pairs.filter("shared = 2")) == [(1, 7, 2)]
    small = m.filter("node < 40")
    assert rows_of(H.co_members(small, block=7)) == rows_of(H.co_members(small))


def plain_dfs(edges, at, depth):
    after = defaultdict(list)
    for a, b, *_ in edges:
        after[a].append(b)
    seen, out, stack = set(), [], [(at, 0)]
    while stack:
        v, d = stack.pop()
        if v not in seen:
            seen.add(v)
            out.append((v, d))
            stack += [(x, d + 1) for x in sorted(after[v], reverse=True) if x not in seen and d < depth]
    return out


def test_depth_first(spark):
    for seed, depth in ((1, 10), (2, 3)):
        edges = random_edges(seed)
        e = spark.createDataFrame(edges, SCHEMA)
        got = [(r["node"], r["depth"]) for r in V.dfs(e, F.lit(edges[0][0]).cast("long"), depth).orderBy("nth").collect()]
        assert got == plain_dfs(edges, edges[0][0], depth)
    assert [r["node"] for r in V.dfs(e, F.lit(edges[0][0]).cast("long"), 3, max_results=2).collect()] == [v for v, _ in plain_dfs(edges, edges[0][0], 3)][:2]


def test_a_star_and_flow_without_a_driver(spark):
    edges = random_edges(2)
    e = spark.createDataFrame(edges, SCHEMA)
    best = {(r["source"], r["node"]): r["distance"] for r in V.shortest_distances(e, N.vertices(e)).collect()}
    (s, t) = max(best, key=lambda k: best[k])
    h = spark.createDataFrame([(v, best[v, t]) for v, w in best if w == t], "node long, h double")
    L = lambda x: F.lit(x).cast("long")  # noqa: E731,N806
    for guess in (None, h):
        got = V.a_star(e, L(s), L(t), guess).first()
        weight = {(a, b): w for a, b, w in edges}
        assert got["distance"] == best[s, t] == sum(weight[p] for p in zip(got["path"], got["path"][1:]))
    flow = spark.createDataFrame([(0, 1, 3.0), (0, 2, 2.0), (1, 2, 5.0), (1, 3, 2.0), (2, 3, 3.0)], SCHEMA)
    assert N.maximum_flow(flow, 0, 3, most_edges=0) == 5.0


def test_motifs_of_four(spark):
    edges = random_edges(6, 9, 34)
    pairs = {(min(a, b), max(a, b)) for a, b, _ in edges}
    want = defaultdict(int)
    for four in itertools.combinations(range(9), 4):
        inside = [p for p in itertools.combinations(four, 2) if p in pairs]
        d = sorted(sum(v in p for p in inside) for v in four)
        kind = {(3, 3, 3, 3): "clique", (2, 2, 3, 3): "diamond", (2, 2, 2, 2): "cycle", (1, 2, 2, 3): "paw", (1, 1, 1, 3): "star", (1, 1, 2, 2): "path"}.get(tuple(d))
        if kind:
            want[kind] += 1
    got = {r["kind"]: r["n"] for r in M.motifs(spark.createDataFrame(edges, SCHEMA), 4).collect()}
    assert {k: n for k, n in got.items() if n} == dict(want)


def test_isomorphism_of_regular_graphs(spark):
    ring = [(i, (i + 1) % 6) for i in range(6)]
    two = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3)]  # the same degrees, so colours alone can't tell
    g = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    assert M.isomorphic(g(ring), g([(10 + (2 * a) % 7, 10 + (2 * b) % 7) for a, b in ring])) and not M.isomorphic(g(ring), g(two))


def test_degree_bounds_and_nodes_alone(spark):
    e = spark.createDataFrame([("a", "b", "X", 1.0), ("b", "c", "X", 1.0), ("a", "c", "X", 1.0)], "src string, dst string, type string, weight double")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    p = M.Pattern([M.NodeSpec("y", max_degree=0, direction="out")], [M.EdgeSpec("x", "y")])
    assert rows_of(M.match(e, p), "x", "y") == [("a", "c"), ("b", "c")]
    assert rows_of(M.match(e, M.Pattern([M.NodeSpec("v")]), nodes)) == [("a",), ("b",), ("c",), ("d",)]
    assert M.match(e, M.Pattern([M.NodeSpec("v"), M.NodeSpec("w")]), nodes).count() == 12


def test_walks_agree_and_follow_edges(spark):
    edges = random_edges(5)
    e = spark.createDataFrame(edges, SCHEMA)
    walk = lambda: rows_of(V.random_walks(e, N.vertices(e), 5, seed=3, weighted=True))
    rows = walk()
    assert rows == walk()
    pairs = {(a, b) for a, b, _ in edges}
    at = {(w, s): v for w, v, s in rows}
    assert all((at[w, s], at[w, s + 1]) in pairs or at[w, s + 1] == w for w, s in at if (w, s + 1) in at)


def test_simple_and_shortest_paths(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 1.0), (2, 4, 9.0), (4, 1, 1.0)], SCHEMA)
    L = lambda x: F.lit(x).cast("long")  # noqa: E731,N806
    assert [r["path"] for r in V.k_shortest(e, L(1), L(4), 2).collect()] == [[1, 2, 3, 4], [1, 3, 4]]
    assert rows_of(V.all_shortest_paths(e, L(1), L(4), 5, "out"), "path") == [((1, 2, 4),), ((1, 3, 4),)]
    layers, cycle = V.topological_layers(e)
    assert cycle and layers.count() == 0
    assert rows_of(V.k_hop(e, L(1), 2)) == [(2, 1), (3, 1), (4, 2)]
    assert rows_of(V.dispatch(e, L(1), "dijkstra", 4), "node", "distance") == [(1, 0.0), (2, 1.0), (3, 2.0), (4, 3.0)]


def test_similar_matches_are_removed_greedily(spark):
    r = random.Random(4)
    rows = [(i, r.randrange(4), r.randrange(4), r.randrange(4), float(r.randrange(20))) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, a int, b int, c int, score double")
    kept = []
    for x in sorted(rows, key=lambda x: (-x[4], x[1], x[2], x[3])):
        if not any(sum(p == q for p, q in zip(x[1:4], y[1:4], strict=True)) >= 0.6 * 3 for y in kept):
            kept.append(x)
    got = M.without_similar(df, ["a", "b", "c"], "score", 0.6)
    assert sorted((x["a"], x["b"], x["c"]) for x in got.collect()) == sorted(x[1:4] for x in kept)


def test_hypergraph(spark):
    m = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 3), (2, 4), (3, 5), (3, 5)], "hid long, node long")
    L = lambda x: F.lit(x).cast("long")  # noqa: E731,N806
    assert rows_of(H.find(m, [3], 2)) == [(1, 3), (2, 2)]
    assert rows_of(H.ball(m, L(1), 2)) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    assert rows_of(H.shortest_path(m, L(1), L(4))) == [((1, 3, 4), (1, 2))]
    assert H.shortest_path(m, L(1), L(5)).count() == 0
    assert rows_of(H.sizes(m)) == [(1, 3), (2, 2), (3, 1)]
    assert H.clusters(m, L(1), 1, 5).count() == 0
    assert H.eigenvector(m).count() == 4
    named = m.select(F.concat(F.lit("h"), "hid").alias("hid"), F.concat(F.lit("n"), "node").alias("node"))
    assert rows_of(H.shortest_path(named, "n1", "n4")) == [(("n1", "n3", "n4"), ("h1", "h2"))]
    assert {r["node"] for r in H.communities(named).collect()} == {"n1", "n2", "n3", "n4"}
    kept, missing = H.create(m, spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "id long"))
    assert rows_of(missing) == [(3, 1)] and kept.count() == 5
    assert {r["community"] for r in H.modularity_clusters(named).collect()} <= {"n1", "n2", "n3", "n4"}
    assert sorted(r["line"] for r in H.export(m).collect())[0] == '{"hid":1,"members":[1,2,3]}'


def test_reification(spark):
    e = spark.createDataFrame([(1, "a", "b", "KNOWS", 0.9), (2, "b", "c", "LIKES", 0.4)], "id long, src string, dst string, type string, confidence double")
    nodes, links = R.reify(e)
    assert rows_of(R.unreify(nodes, links)) == [("1", "a", "b", "KNOWS", 0.9), ("2", "b", "c", "LIKES", 0.4)]
    assert R.unreify(nodes, links.filter("type = 'FROM'")).count() == 0
    (_, some), missing = R.reify_valid(e, spark.createDataFrame([(1,), (9,)], "id long"))
    assert some.count() == 2 and rows_of(missing) == [(9,)]
    assert rows_of(R.statistics(nodes, links)) == [("KNOWS", 1, 1), ("LIKES", 1, 1)]
    deep, deeper = R.reify_again(nodes, links)
    assert deep.count() == 4
    assert rows_of(R.hierarchy(links.unionByName(deeper), "r:r:1/FROM")) == [("a", 1), ("b", 2), ("r:1", 1), ("r:r:1/FROM", 0)]
    versions = spark.createDataFrame([(1, 1, "x")], "id long, version int, v string")
    after = R.update(versions, spark.createDataFrame([(1, "y"), (2, "z")], "id long, v string"))
    assert rows_of(after, "id", "version", "v") == [(1, 1, "x"), (1, 2, "y"), (2, 1, "z")]
    meta = spark.createDataFrame([(1, 2, "contradicts"), (2, 1, "supports")], "rel1 long, rel2 long, type string")
    assert rows_of(R.meta_of(meta, 1)) == [(2, "contradicts"), (2, "supports")]
    evidence = spark.createDataFrame([(1, 0.5), (1, 0.7)], "rel long, reliability double")
    assert rows_of(R.confidence(spark.createDataFrame([(1, None), (2, None)], "id long, confidence double"), evidence)) == [(1, 0.6, 2), (2, None, 0)]


def test_patterns_and_builder(spark):
    e = spark.createDataFrame([("a", "b", "X", 1.0), ("b", "c", "Y", 2.0), ("b", "a", "Y", 2.0), ("a", "a", "X", 1.0)], "src string, dst string, type string, weight double")
    nodes = spark.createDataFrame([("a", "T", "one"), ("b", "T", "two"), ("c", "U", "three")], "id string, type string, label string")
    p = M.Pattern([M.NodeSpec("z", F.col("type") == "U")], [M.EdgeSpec("x", "y", "X"), M.EdgeSpec("y", "z", "Y")])
    assert rows_of(M.match(e, p, nodes), "x", "y", "z") == [("a", "b", "c")]
    free = M.Pattern([], [M.EdgeSpec("x", "y", "X"), M.EdgeSpec("y", "z", "Y")], injective=False)
    assert rows_of(M.match(e, free), "x", "y", "z") == [("a", "b", "a"), ("a", "b", "c")]
    maybe = M.Pattern([], [M.EdgeSpec("x", "y", "Y"), M.EdgeSpec("y", "z", "X", optional=True)])
    assert rows_of(M.match(e, maybe), "x", "y", "z") == [("b", "a", None), ("b", "c", None)]
    q = GraphQuery(Graph(nodes, e)).edges("Y").where(F.col("dst") == "c").page(1)
    assert rows_of(q.rows, "src") == [("b",)] and q.explain() == ("edges Y", "where", "page 0 1")
    s = Script(Graph(nodes.withColumn("properties", F.create_map(F.lit("k"), F.lit("v"))), e))
    out = s.run('node d T\nedge c d Z 2\npath a d\nset a k "w x"\nget a k\nneighbors d # near\nnodes *\n')
    assert rows_of(out[0], "path") == [(("a", "b", "c", "d"),)] and rows_of(out[1]) == [("w x",)] and rows_of(out[2]) == [("c",)] and out[3].count() == 4
    assert reified_statement('REIFY (a)-[:KNOWS]->(b) AS k WITH {since: "2001"}')["properties"] == {"since": "2001"}
    assert reified_statement("UNREIFY k") == {"command": "unreify", "name": "k"} and reified_statement("MATCH (n)") is None


def test_dedup_similar_over_all_pairs(spark, tmp_path):
    from weft.queries import QUERIES, _scored

    # the best 300 pairs have one supplier, so only one of them stays; the others come after them
    lines = [(1, p, 50.0) for p in range(300)] + [(s, p, float(1 + (7 * s + p) % 40)) for s in range(2, 9) for p in range(s, 60, s)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want, s, p = [], set(), set()
    for r in sorted(_scored(spark, str(tmp_path)).collect(), key=lambda r: (-r["score"], r["s"], r["p"])):
        if r["s"] not in s and r["p"] not in p:
            want.append((r["s"], r["p"], r["score"]))
            s.add(r["s"])
            p.add(r["p"])
    assert sorted(map(tuple, QUERIES["dedup_similar"](spark, str(tmp_path)).collect())) == sorted(want) and len(want) == 8
