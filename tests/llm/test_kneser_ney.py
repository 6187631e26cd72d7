from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import arrays as A
from weft.llm import kneser_ney as K


def token_list(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def discounts(counts):
    m = [sum(x == k for x in counts.values()) for k in (1, 2, 3, 4)]
    if not all(m):
        return [0.5, 1.0, 1.5]
    y = m[0] / (m[0] + 2 * m[1])
    return [min(max(k - (k + 1) * y * m[k] / m[k - 1], 0), k) for k in (1, 2, 3)]


def ending(x, i, n):
    """The n-gram that ends at token i."""
    return tuple((["<begin>"] * n + x)[i + 1 : i + 1 + n])


def brute(rows, order=2):
    texts = [(i, token_list(t)) for i, t in rows]
    train = [x for i, x in texts if not held(i)]
    c1 = Counter(w for x in train for w in x)
    n, v = sum(c1.values()), len(c1)
    c = {order: Counter(ending(x, i, order) for x in train for i in range(len(x)))}
    for k in range(order - 1, 0, -1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    d = {k: discounts(x) for k, x in c.items()}
    total, kinds = Counter(), defaultdict(lambda: [0, 0, 0])
    for k in c:
        for g, x in c[k].items():
            total[k, g[:-1]] += x
            kinds[k, g[:-1]][min(x, 3) - 1] += 1

    def p(g):
        k = len(g)
        if not k:
            return 1 / (v + 1)
        t, x = total[k, g[:-1]], c[k].get(g, 0)
        if not t:
            return p(g[1:])
        return (x - d[k][min(x, 3) - 1] if x else 0) / t + sum(a * b for a, b in zip(d[k], kinds[k, g[:-1]], strict=True)) / t * p(g[1:])

    out = []
    for i, x in texts:
        base = sum(math.log10((c1[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)
        kn = sum(math.log10(p(ending(x, j, order))) for j in range(len(x)))
        out.append((i, held(i), len(x), sum(c1[w] > 0 for w in x), n, base, kn))
    sums = [sum(p((*u, w)) for w in c1) + p((*u, "never seen \n")) for u in [(), *(g[:-1] for k in c for g in list(c[k])[:3])]]
    return out, sums


def check(df, rows, order=2):
    got = sorted(([r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]] for r in K.score_held_out(df, order=order).collect()), key=repr)
    want, ones = brute(rows, order)
    assert all(abs(x - 1) < 1e-9 for x in ones)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(map(list, want), key=repr), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_documents(spark, sample, order):
    check(sample, [(r["doc_id"], r["text"]) for r in sample.collect()], order)


@pytest.mark.parametrize(("order", "fan", "files"), [(2, 12, 16), (3, 12, 2), (4, 2, 1)])
def test_many_shards_and_hot_words(spark, monkeypatch, order, fan, files):
    for name, x in (("TOKENS_A_SHARD", 200), ("GRAMS_A_SHARD", 300), ("FAN_BITS", fan), ("FILE_BITS", files)):
        monkeypatch.setattr(K, name, x)
    rows = [(i, " ".join(["the", f"w{i % 17}", "the", "the", f"x{i * 7 % 61}", "The end"][: i % 7])) for i in range(400)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, order)


def test_odd_rows(spark, odd, none):
    check(odd.withColumn("score", F.lit(1)).withColumn("shard", F.lit(1)), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert K.score_held_out(none).count() == 0
    only = [i for i in range(200) if held(i)][:3]  # nothing to learn from
    rows = [(i, "a b") for i in only]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 3)


def test_wide_counts_and_packed_arrays():
    big = np.array([1, 2**33], np.int64)
    key = np.array([5, 9], np.uint64)
    got = K.unpack([K.pack(key, big), K.pack(key, np.array([3, 4]))])
    assert got[0].tolist() == [5, 9, 5, 9] and got[1].tolist() == [1, 2**33, 3, 4]
    assert K.summed(got[0], [got[1]])[1][0].tolist() == [4, 2**33 + 4]


def test_files_of_many_shards(tmp_path):
    from pyarrow import fs

    for _ in range(2):  # a task that is run again
        w = A.Writer(f"file://{tmp_path}/x", "a-0")
        w.add(3, token=np.arange(5, dtype=np.uint64), count=np.array([1, 2, 3, 4, 2**40]))
        w.add(4, token=np.zeros(0, np.uint64), count=np.zeros(0, np.int64))
        w.close()
    r = A.Reader(f"file:{tmp_path}/x", "a-0")
    assert r.arrays(3)["token"].tolist() == [0, 1, 2, 3, 4] and r.arrays(3)["count"].tolist()[-1] == 2**40 and len(r.arrays(4)["token"]) == 0 and r.arrays(9) == {}
    far = A.Reader.__new__(A.Reader)  # as from a store that cannot be mapped
    far.mapped, far.file, far.index = None, fs.LocalFileSystem().open_input_file(f"{tmp_path}/x/a-0"), r.index
    assert far.arrays(3)["count"].tolist() == r.arrays(3)["count"].tolist()
    store, path = A.place("mock:///z")
    assert not isinstance(store, fs.LocalFileSystem) and path
