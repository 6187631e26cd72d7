from __future__ import annotations

import re

import numpy as np
import xxhash

from pyspark.sql import functions as F
from tests.conftest import rows_of
from weft.llm import simhash as S


def print_of(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints, bits=3):
    ids = list(range(len(prints)))
    x = np.array(prints, np.uint64)

    def find(a):
        while ids[a] != a:
            a = ids[a]
        return a

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= bits):
            a, b = find(i), find(i + 1 + int(j))
            ids[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(x))]


def test_documents(spark, sample, odd):
    for df in (sample, odd.withColumn("fp", F.lit(1)).withColumn("root", F.lit("r"))):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        prints = [print_of(t) for _, t in rows]
        root = linked(prints)
        least = {}
        for (i, _), r in zip(rows, root, strict=True):
            least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
        want = sorted(((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, root, strict=True)), key=repr)
        assert rows_of(S.near_duplicates(df), "doc_id", "fingerprint", "component_id") == want
        kept = rows_of(S.deduplicate(df), "doc_id")
        assert kept == sorted({(v,) for v in least.values()}, key=repr) and S.deduplicate(df).columns == df.columns


def groups(parts):
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for g in parts:
        for b in g[1:].tolist():
            root[find(b)] = find(int(g[0]))
    out = {}
    for a in root:
        out.setdefault(find(a), set()).add(a)
    return sorted(map(sorted, out.values()))


def test_trees_lose_no_link():
    rng = np.random.default_rng(5)
    flip = lambda x: x ^ (np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64))
    x = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    near = [x[:500], flip(x[:500]), flip(flip(x[500:900])), flip(flip(flip(x[900:1500])))]
    centre = np.full(800, x[7])
    cluster = flip(flip(flip(flip(centre))))  # a dense group
    half = (x[:600] & np.uint64(0xFFFFFFFF00000000)) | np.uint64(0xABCDEF01)  # halves that are all alike
    every = np.unique(np.concatenate([x, *near, cluster, half]))
    found = groups([g for m in S.HALVES for g in S.search(every, m, few=32)])
    assert found == groups(S.linked(every))


def test_shards_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    y = np.unique(np.concatenate([x, x[:400] ^ np.uint64(5), x[400:700] ^ np.uint64(1 << 40 | 1), x[:100] ^ np.uint64(1 << 63)]))
    df = spark.createDataFrame([(int(v),) for v in y.view(np.int64)], "fp long")
    edges = S.links(df, sample=512, shard=100).collect()
    got = groups([np.array([r["fp"], r["other"]], np.int64).view(np.uint64) for r in edges])
    assert got == groups(S.linked(y))
    roots = {r["fp"]: r["root"] for r in S.components(spark.createDataFrame(edges)).collect()}
    for g in got:
        own = np.array(g, np.uint64).view(np.int64).tolist()
        assert {roots.get(v, v) for v in own} == {min(own)}


def test_chain_and_empty(spark, none):
    chain = spark.createDataFrame([(i + 1, i) for i in range(60)], "fp long, other long")
    assert {r["root"] for r in S.components(chain).collect()} == {0}
    assert S.near_duplicates(none).count() == 0 and S.deduplicate(none).count() == 0


def test_deeper_trees_lose_no_link(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = base[:600] ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)) for _ in range(600)], np.uint64)
    fps = np.unique(np.concatenate([base, near])).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    edges = S.links(df, sample=64, shard=100)
    assert edges.count() >= 600
    one = lambda e: {r["fp"]: r["root"] for r in S.components(e).collect()}
    assert one(edges) == one(S.links(df, sample=65_536, shard=10**6))


def test_extra_columns_without_an_order(spark):
    rows = [(1, "a b c d", {"x": "1"}), (1, "a b c d", {"x": "0"}), (2, "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,string>")
    got = S.deduplicate(df).collect()
    assert sorted((r["doc_id"], str(r["extra"])) for r in got) == [(1, "{'x': '0'}"), (2, "None")]
