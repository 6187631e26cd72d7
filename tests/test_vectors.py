"""Nearest vectors by products of blocks against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from weft.operators import text as X
from weft.operators import vectors as V


def some(r, n, kind):
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)] if r.random() < 0.5 else [r.gauss(0, 1) for _ in range(4)]) for i in range(n)]
    return rows + [(n + i, [1.0, 2.0, 3.0, 4.0]) for i in range(12)] + [(3, [1.0, 2.0, 3.0, 4.0])] * 6 + [(n + 20, [0.0] * 4)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_as_all_pairs(spark, monkeypatch, kind):
    rows = spark.createDataFrame(some(random.Random(3), 90, kind), f"id long, v array<{kind}>").repartition(3)
    queries = rows.filter("id % 3 = 0")
    got = X.nearest(rows, queries, "id", "v", 4)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, X._broadcast(rows, queries, "id", "v", 4).collect()))
    assert sorted(map(tuple, got.collect())) == want
    # In small blocks, here.
    monkeypatch.setattr(V, "SIDE", 7)
    data = sorted(rows.collect(), key=lambda r: r["id"])
    ids, x = np.array([r["id"] for r in data]), np.array([r["v"] for r in data], dtype=np.float32 if kind == "float" else np.float64)
    keep = V.least_ids(ids, x, 4)
    q = sorted({i for i in ids.tolist() if i % 3 == 0 and i != 3})
    at = np.array([ids.tolist().index(i) for i in q])
    a, b, s = V.met(ids[at], x[at], ids[keep], x[keep], *V.units(x[keep]), 4)
    assert sorted(zip(a.tolist(), b.tolist(), s.tolist(), strict=True)) == sorted((r[0], r[1], r[2]) for r in want if r[0] != 3)


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [2.0, 4.0])], "id long, v array<double>")
    assert V.regular(rows, "id", "v") is None
    assert len(X.nearest(rows, rows, "id", "v", 2).collect()) == 10
