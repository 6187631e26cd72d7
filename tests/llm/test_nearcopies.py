from __future__ import annotations

import random

import numpy as np

from tests.conftest import rows_of
from weft.llm import nearcopies as N

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sets(t, k=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def kept(rows):
    """The least id of each group, by all pairs."""
    root = {i: i for i, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    each = [(i, sets(t)) for i, t in rows]
    for n, (i, x) in enumerate(each):
        for j, y in each[:n]:
            if len(x & y) >= 0.8 * len(x | y) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i, _ in rows}


def planted():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8)))
    base = [[word() for _ in range(r.choice([30, 120, 300]))] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        for k, share in enumerate((0.005, 0.015, 0.02, 0.05, 0.2)):  # about 0.95, 0.86, 0.82, 0.63 and 0.2
            v = list(w)
            for at in r.sample(range(len(v)), max(1, int(share * len(v)))):
                v[at] = word()
            rows.append((100 + 10 * i + k, " ".join(v)))
    chain = base[39] + [word() for _ in range(200)]
    for k in range(12):  # each near the one before, the ends far apart
        chain[25 * k : 25 * k + 4] = [word() for _ in range(4)]
        rows.append((600 + k, " ".join(chain)))
    return rows


def test_planted_copies(spark):
    import corpus_pipeline

    rows = planted()
    want = kept(rows)
    edited = {i for i, _ in rows if 100 <= i < 600 and i not in want}
    assert len(edited) > 80 and len(want) > 60
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).repartition(3)
    assert {i for (i,) in rows_of(dict(corpus_pipeline.STAGES)["near-dedup"](spark, df, ""), "doc_id")} == want


def test_documents(spark, sample, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in sample.collect()]
    assert {i for (i,) in rows_of(N.deduplicate(sample), "doc_id")} == kept(rows)
    assert N.deduplicate(none).count() == 0
    # 1 to 3 have no words, 7 is there twice
    assert rows_of(N.deduplicate(odd), "doc_id") == sorted([(i,) for i in (1, 4, 5, 6, None, 7)], key=repr)


def test_groups_are_exact():
    r = np.random.default_rng(2)
    base = [r.integers(0, 3000, 60) for _ in range(12)]
    every = [np.unique(np.concatenate([b[k:], r.integers(0, 3000, k)])).astype(np.uint64) for b in base for k in range(0, 20, 2)]
    got, near = N.linked(every), [set(s.tolist()) for s in every]
    root = list(range(len(every)))
    for i, x in enumerate(near):
        for j, y in enumerate(near[:i]):
            if len(x & y) >= 0.8 * len(x | y) - 1e-9:
                a, b = root[i], root[j]
                root = [min(a, b) if v in (a, b) else v for v in root]
    assert got == root


def test_large_groups_in_blocks(spark, monkeypatch):
    r = random.Random(12)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(90):
        t = list(base)
        t[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(t)))
    want = kept(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x for (x,) in rows_of(N.deduplicate(df), "doc_id")} == want
    monkeypatch.setattr(N, "GROUP", 16)
    assert {x for (x,) in rows_of(N.deduplicate(df), "doc_id")} == want
