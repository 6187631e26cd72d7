from __future__ import annotations

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from weft.llm import mixing, urls


def test_rules_and_parts(spark):
    given = [
        (1, "http://WWW.Example.COM/en/1"), (2, "https://example.com/en/77?x"), (3, "http://a.net/de/8"), (4, "http://example.net/de/8#t"), (5, "x://org/es/"), (6, "http://notorg/es/"),
        (7, None), (8, "no scheme"), (9, ""), (10, "http://a.com?x=://b"), (11, "http://a.com#/en/"), (None, "http://b.com/en/"), (1, "http://WWW.Example.COM/en/1"),
    ]
    df = spark.createDataFrame(given, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("blocked", F.lit(1))
    labels = spark.createDataFrame([], "page_id long, blocked boolean")
    got = rows_of(urls.judge(df, labels))
    assert got == sorted([
        (1, "www.example.com", "/en/1", "com/en/", "block"), (1, "www.example.com", "/en/1", "com/en/", "block"), (2, "example.com", "/en/77", "example.com/en/7", "allow"), (3, "a.net", "/de/8", "net/de/", "block"),
        (4, "example.net", "/de/8", "example.net/de/8", "block"), (5, "org", "/es/", "org/es/", "block"), (6, "notorg", "/es/", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"),
        (9, "", "", None, "allow"), (10, "a.com", "", None, "allow"), (11, "a.com", "", None, "allow"), (None, "b.com", "/en/", "com/en/", "block"),
    ], key=repr)
    assert urls.judge(df.limit(0), labels).count() == 0


def test_mined_combinations(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        host, first, key = r.choice(["spam.biz", "fine.info"]), r.choice(["buy", "read"]), r.choice(["ref", "page"])
        rows.append((i, f"http://{host}/{first}/{i}?{key}=1"))
        labels.append((i, host == "spam.biz" and first == "buy"))
    pages, lab = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([*labels, (5, None), (None, True)], "page_id long, blocked boolean")
    rules = urls.mine(pages, lab)[0].collect()
    assert rules and all(any("spam" in t or t == "d:biz" for t in x["items"]) and "p:buy" in x["items"] and len(x["items"]) == 2 for x in rules)
    new = spark.createDataFrame([(1, "http://spam.biz/buy/9999"), (2, "http://spam.biz/read/9999"), (3, "http://fine.info/buy/1"), (4, "https://spam.biz/x/buy?ref=2")], "page_id long, url string")
    verdicts = dict(rows_of(urls.judge(pages.unionByName(new.withColumn("page_id", F.col("page_id") + 10_000)), lab), "page_id", "verdict"))
    assert [verdicts[10_000 + i] for i in (1, 2, 3, 4)] == ["block", "allow", "allow", "block"]


def plain_tokens(url):
    if url is None or "://" not in url:
        return set()
    scheme, rest = url.split("://", 1)
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    labels = host.lower().split(".")
    out = {f"s:{scheme}", f"w:{labels[0]}"} | {"d:" + ".".join(labels[i:]) for i in range(len(labels))}
    out |= {"p:" + re.sub("[0-9]+", "0", re.sub(r"\.[a-z]+$", "", p)) for p in path.lower().split("/") if p}
    if m := re.search(r"\.([A-Za-z0-9]+)$", path):
        out.add("e:" + m[1])
    if m := re.match(r"^[^?#]*\?([^#]*)", url):
        out |= {"q:" + k.split("=")[0] for k in m[1].split("&") if k}
    return out | ({"f:"} if "#" in url else set())


def plain_rules(rows):
    """All combinations of up to three tokens, counted one by one."""
    n, blocked, seen = len(rows), sum(y for _, y in rows), {}
    for t, y in rows:
        for k in (1, 2, 3):
            for c in itertools.combinations(sorted(t), k):
                x = seen.setdefault(c, [0, 0])
                x[0] += 1
                x[1] += y
    least = max(8, math.ceil(n * 0.0005))
    return [set(c) for c, (m, hit) in seen.items() if m >= least and hit / m >= 0.6 and hit / m >= 1.5 * blocked / n]


@pytest.mark.parametrize("most", [14, 0])
def test_miner_against_all_combinations(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "FP_ITEMS", most)  # FP-growth, and level by level
    r = random.Random(7)
    rows = []
    for i in range(400):
        host, part, key = r.choice(["a.x.org", "b.x.org", "y.biz"]), r.choice(["in", "out", "up"]), r.choice(["k", "l"])
        rows.append((i, f"http{r.choice(['', 's'])}://{host}/{part}/{r.choice('pq')}{i}.html?{key}={i}" + r.choice(["", "#t"])))
    bad = lambda u: ("b.x.org/in" in u and "?k" in u) or ("y.biz/up" in u)
    labels = [(i, bool(bad(u)) if r.random() < 0.9 else r.random() < 0.3) for i, u in rows]
    verdicts = dict(rows_of(urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, blocked boolean"), rules=()), "page_id", "verdict"))
    rules = plain_rules([(plain_tokens(u), int(y)) for (_, u), (_, y) in zip(rows, labels, strict=True)])
    want = {i: "block" if any(map(plain_tokens(u).issuperset, rules)) else "allow" for i, u in rows}
    assert verdicts == want and 20 < sum(v == "block" for v in want.values()) < 300


def test_urls_with_many_parts_and_labels(spark):
    trap = "/".join(f"part{chr(97 + i)}" for i in range(26))
    rows = [(i, f"http://trap.biz/{trap}/{'x' * (i % 7)}/{i}") for i in range(100)] + [(100 + i, f"http://good.info/{'/'.join(trap.split('/')[i % 13 :])}") for i in range(100)]
    rows += [(300, "http://" + "a." * 5000 + "org/es/" + "z" * 100_000), (301, "http://" + "h" * 70_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 100) for i in range(200)], "page_id long, blocked boolean")
    got = dict(rows_of(urls.judge(pages, labels), "page_id", "verdict"))
    rules = plain_rules([(plain_tokens(u), int(i < 100)) for i, u in rows[:200]])
    assert all(got[i] == ("block" if any(map(plain_tokens(u).issuperset, rules)) else "allow") for i, u in rows[:200])
    assert all(got[i] == "block" for i in range(100)) and sum(got[i] == "allow" for i in range(100, 200)) > 60 and got[300] == "block" and got[301] == "allow"


def filled(sizes, weights, epochs=3):
    """Round by round, as it is told."""
    total, target, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(target[i] for i in range(len(sizes)) if i not in free)
        share = left / sum(weights[i] for i in free)
        over = {i for i in free if weights[i] * share > epochs * sizes[i] + 1e-9}
        if not over:
            for i in free:
                target[i] = weights[i] * share
            break
        for i in over:
            target[i] = float(epochs * sizes[i])
        free -= over
    return target


def test_targets_and_taken_words(spark):
    r = random.Random(3)
    sources = [f"s{i:02d}" for i in range(9)] + [None]
    rows = [(i, " ".join(["w"] * (r.randrange(1, 5) ** 4)), s) for i, s in enumerate(r.choices(sources, [300, 1, 2, 50, 3, 9, 1, 20, 5, 4], k=700))]
    rows += [(1000, None, "s00"), (1001, "", "zz"), (None, "a b c", "s03"), (7777, "a b", "s03"), (7777, "a b", "s03")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("_s", F.lit(0))
    df = df.withColumn("source_size", F.lit(0))
    got = mixing.mix(df).collect()
    size = lambda t: len((t or "").split())
    by = {}
    for _, t, s in rows:
        by[s] = by.get(s, 0) + size(t)
    order = sorted((s for s in by if s is not None)) + [None]
    target = dict(zip(order, filled([by[s] for s in order], [i % 3 + 1 for i in range(len(order))]), strict=True))
    taken = {}
    for g in got:
        assert g["source_size"] == by[g["source"]] and abs(g["target"] - target[g["source"]]) < 1e-6 and 0 <= g["taken"] <= 3 * g["size"] and g["size"] == size(g["text"])
        taken[g["source"]] = taken.get(g["source"], 0) + g["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in order)
    assert rows_of(mixing.mix(df.repartition(7)), "doc_id", "taken") == rows_of(mixing.mix(df), "doc_id", "taken")
    again = mixing.repetitions(mixing.mix(df))
    assert again.agg(F.sum("words")).first()[0] == sum(taken.values())
    assert all(size(x["text"]) == x["words"] for x in again.collect())
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).first()["taken"] == 0


def test_given_weights(spark):
    df = spark.createDataFrame([(1, "a b c d", "x"), (2, "a b", "y"), (3, "a b", "z")], "doc_id long, text string, source string")
    w = spark.createDataFrame([("x", 1), ("y", 1), ("z", 0)], "source string, weight long")
    assert rows_of(mixing.mix(df, weights=w), "doc_id", "target", "taken") == [(1, 4.0, 4), (2, 4.0, 4), (3, 0.0, 0)]


def test_rows_of_one_id(spark):
    rows = [(None, "a b c", "x")] * 300 + [(None, f"w{i} w", "x") for i in range(100)] + [(1, "z " * 50, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    w = spark.createDataFrame([("x", 7), ("y", 1)], "source string, weight long")
    for part in (df, df.repartition(5)):
        got = mixing.mix(part, weights=w, epochs=2).collect()
        total = sum(r["taken"] for r in got if r["source"] == "x")
        assert total == round(next(r["target"] for r in got if r["source"] == "x")) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    a, b = (sorted((r["text"], r["taken"]) for r in mixing.mix(part, weights=w, epochs=2).collect()) for part in (df, df.repartition(5)))
    assert a == b


def test_targets_of_many_sources(spark):
    r = random.Random(9)
    rows = [(f"s{i:04d}", r.choice([0, 1, 5, 40, 4000]) * r.randrange(1, 9), i % 3 + 1) for i in range(500)]
    sized = spark.createDataFrame(rows, "source string, source_size long, weight long")
    got = {x["source"]: x["target"] for x in mixing.targets(sized).collect()}
    assert all(abs(got[s] - t) < 1e-6 for (s, _, _), t in zip(rows, filled([n for _, n, _ in rows], [w for _, _, w in rows]), strict=True))
    numbered = mixing.cycled_weights(sized.drop("weight").repartition(7)).collect()
    assert {x["source"]: x["weight"] for x in numbered} == {s: w for s, _, w in rows}
