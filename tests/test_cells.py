"""Graphs and matrices in cells of files against plain versions; paths of two edges must not be rows."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import pytest

from tests.conftest import DATA, rows_of
from weft import queries
from weft.operators import analytics as N
from weft.operators import cells as K
from weft.operators import match as M
from weft.queries import QUERIES


def near_of(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return near


def random_graph(seed, n=40, m=260):
    r = random.Random(seed)
    hub = [(0, i) for i in range(1, n)]
    return [(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a != b] + hub


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("blocks", "name"), [(1, int), (3, int), (2, lambda x: x * 10**15 - 7 * 10**15), (2, lambda x: f"n{x:03d}")])
def test_triangles_and_pairs(spark, monkeypatch, blocks, name):
    monkeypatch.setattr(K, "CHUNK", 50)  # for what is called here
    edges = [(name(a), name(b)) for a, b in random_graph(blocks)]
    kind = "string" if isinstance(edges[0][0], str) else "long"
    e, near = spark.createDataFrame(edges, f"src {kind}, dst {kind}"), near_of(edges)
    want = [t for t in itertools.combinations(sorted(near), 3) if t[1] in near[t[0]] and t[2] in near[t[0]] and t[2] in near[t[1]]]
    found = K.triangles(e, blocks)
    assert rows_of(found) == sorted(want, key=repr)
    assert rows_of(K.triangle_counts(e, blocks)) == sorted(Counter(x for t in want for x in t).items(), key=repr)
    pairs = [(a, b, float(f"{len(near[a] & near[b]) / len(near[a] | near[b]):.9g}")) for a, b in itertools.combinations(sorted(near), 2) if near[a] & near[b]]
    assert rows_of(K.structural_similarity(e, blocks), "a", "b", "similarity") == sorted(pairs, key=repr)
    summed = {a: (len(x), max(x), round(sum(x), 6)) for a, x in ((a, [p[2] for p in g]) for a, g in itertools.groupby(pairs, lambda p: p[0]))}
    assert {r["a"]: (r["n"], float(f"{r['most']:.9g}"), round(r["total"], 6)) for r in K.similarity_rows(e, blocks).collect()} == summed
    # The same in pieces of 50 paths.
    ways, both = K.oriented_cells(e, blocks), K.undirected_cells(e, blocks)
    assert sum(len(t["a"]) for r in range(blocks) for t in K.triangle_rows(ways, r)) == len(want)
    assert sum(len(t["a"]) for r in range(blocks) for t in K.similar(both, r)) == len(pairs)
    four = sum(all(y in near[x] for x, y in itertools.combinations(q, 2)) for q in itertools.combinations(sorted(near), 4))
    assert sum(int(t["n"][0]) for r in range(blocks) for t in K.cliques(ways, r)) == four > 0
    monkeypatch.setattr(K, "BLOCK", 20)  # rows are parted
    assert sum(int(t["n"][0]) for r in range(blocks) for t in K.cliques(ways, r)) == four


def test_motifs_of_many_blocks(spark, monkeypatch):
    edges = random_graph(5, 16, 40)
    e = spark.createDataFrame(edges, "src long, dst long")
    monkeypatch.setattr(K, "SOME", 8)
    near, kinds = near_of(edges), Counter()
    names = {(3, 3, 3, 3): "clique", (2, 2, 3, 3): "diamond", (2, 2, 2, 2): "cycle", (1, 2, 2, 3): "paw", (1, 1, 1, 3): "star", (1, 1, 2, 2): "path"}
    for q in itertools.combinations(sorted(near), 4):
        kinds[names.get(tuple(sorted(sum(y in near[x] for y in q) for x in q)))] += 1
    assert {r["kind"]: r["n"] for r in M.motifs(e, 4).collect()} == {k: kinds[k] for k in names.values()}


@pytest.mark.parametrize("blocks", [1, 3])
def test_product_rows(spark, blocks):
    r = random.Random(blocks)
    make = lambda: list({(r.randrange(20), r.randrange(20)): 0 for _ in range(90)})
    a, b = ([(i, j, r.choice([0.5, 2.0, -1.0, 3.0])) for i, j in make()] for _ in range(2))
    for left, right in ((a, None), (a, b), ([(i, j, 2.0) for i, j, _ in a], None)):
        other, want = defaultdict(list), defaultdict(Counter)
        for i, j, v in right or left:
            other[i].append((j, v))
        for i, k, v in left:
            for j, w in other[k]:
                want[i][j] += v * w
        x, y = (None if t is None else spark.createDataFrame(t, "i long, j long, value double") for t in (left, right))
        assert rows_of(K.product_rows(x, y, blocks), "i", "n", "total") == sorted(((i, len(c), float(sum(c.values()))) for i, c in want.items()), key=repr)


def test_no_edges(spark):
    e = spark.createDataFrame([(1, 1)], "src long, dst long").filter("src = 0")
    assert rows_of(M.triangles(e)) == rows_of(N.triangle_counts(e)) == rows_of(N.clustering(e)) == rows_of(K.structural_similarity(e)) == []
    assert {r["n"] for r in M.motifs(e, 4).collect()} == {0}


@pytest.mark.parametrize("name", ["triangle_pattern", "triangle_count", "matrix_product", "structural_similarity"])
def test_paths_are_not_joined(spark, name):
    assert "Join" not in plan(QUERIES[name](spark, DATA))
    assert "Join" not in plan(queries.part_pairs(spark, DATA))


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none, empty = sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(empty, False, False, none, empty)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_louvain_shuffles_no_edges(spark):
    groups = [(10 * a, 10 * a + 500) for a in range(4)]
    edges = [(a, b, 1.0) for lo, hi in groups for a, b in itertools.combinations([*range(lo, lo + 10), *range(hi, hi + 10)], 2)] + [(0, 10, 0.5), (20, 30, 0.5)]
    e = spark.createDataFrame(edges * 10, "src long, dst long, weight double")  # parallel edges add up
    before = shuffled(spark)
    found = {r["node"]: r["community"] for r in N.louvain(e).collect()}
    assert shuffled(spark) - before < len(edges) * 10
    assert len(set(found.values())) == 4 and all(found[x] == found[lo] for lo, hi in groups for x in (lo + 9, hi, hi + 9))


@pytest.mark.parametrize("name", ["matrix_product", "structural_similarity"])
def test_edges_are_not_grouped_before(spark, name):
    pairs, before = queries.part_pairs(spark, DATA).count(), shuffled(spark)
    QUERIES[name](spark, DATA).collect()
    assert shuffled(spark) - before < pairs // 2


def test_motifs_write_edges_once(spark, monkeypatch):
    names, write = [], K.write
    monkeypatch.setattr(K, "write", lambda e, n, ids, name, *more, **named: names.append(name) or write(e, n, ids, name, *more, **named))
    M.motifs(spark.createDataFrame(random_graph(7, 12, 30), "src long, dst long"), 4).collect()
    assert sorted(names) == ["degrees", "oriented"]
