from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.conftest import rows_of
from weft.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, k=10):
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for item, x in items:
            v = words(x)
            n = min(k, len(v))
            grams = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if n else set()
            for a in range(len(w) - n + 1 if n else 0):
                if tuple(w[a : a + n]) in grams:
                    hit |= set(range(a, a + n))
                    found.add(str(item))
        ids = ",".join(sorted(found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def result(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("x")).withColumn("row", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("pos", F.lit(1))
    return rows_of(D.contamination(D.build_index(d), i), "doc", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_against_all_windows(spark):
    r = random.Random(1)
    vocabulary = ["the", "of", "ÀB", "x1", "Go", "é"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([1, 3, 9, 10, 11, 14, 25])] + [(20, None), (21, ""), (3, "the the the")]
    docs = [(i, say(r.randrange(60))) for i in range(40)] + [(50, None), (51, ""), (52, " ".join(x for _, x in items[3:6]).upper()), (53, "... the --- of ..."), (52, "again")]
    assert result(spark, docs, items) == brute(docs, items)


def test_runs_across_items_and_ties(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(1, f"a {item} b"), (2, " ".join(f"w{i}" for i in range(9))), (3, " ".join(f"w{i}" for i in range(5, 16))), (4, item + " " + item), (5, " ".join(["w1", *(f"w{i}" for i in range(3, 30))]))]
    items = [(1, item), (2, item), (2, "w3 w4")]
    assert result(spark, docs, items) == brute(docs, items)
    assert result(spark, docs, []) == brute(docs, []) and result(spark, [], items) == []


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    docs = [(i, f"x y z {i} a b c d e f g h i j k l {i}") for i in range(20)]
    items = [(1, "a b c d e f g h i j k l"), (2, "y z")]
    monkeypatch.setattr(D, "MOST_BROADCAST", 0)
    monkeypatch.setattr(D, "MOST_FOUND", 0)
    assert result(spark, docs, items) == brute(docs, items)


def near(docs, items, slop):
    """Items of which the rarest term has all the others within slop words, by document."""
    said = [(i, words(t)) for i, t in docs]
    n = Counter(w for _, ws in said for w in ws)
    out = set()
    for item, t in items:
        terms = sorted(set(words(t)), key=lambda w: (n[w], w))
        for i, ws in said if terms else []:
            if any(w == terms[0] and set(terms) <= set(ws[max(0, p - slop) : p + slop + 1]) for p, w in enumerate(ws)):
                out.add((i, item))
    return sorted(out)


def test_proximity_against_all_places(spark, monkeypatch):
    r = random.Random(5)
    docs = [(1, "a q q b q c"), (2, "a q q q q q b c"), (3, "c b a"), (4, "a b"), (5, None)] + [(10 + i, " ".join(r.choice("abcdefgh") for _ in range(40))) for i in range(20)]
    items = [(7, "a b c"), (8, "a zz"), (9, "d"), (10, "a b c d e f"), (11, ""), (12, "g g h a b")]
    for blocks, slop in ((12, 3), (2, 7)):
        monkeypatch.setattr(D, "BLOCK_BITS", blocks)
        index = D.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
        found = D.proximity_matches(index, spark.createDataFrame(items, "item_id long, text string"), slop).join(D.documents_of(index), ["shard", "at"])
        assert sorted(set(rows_of(found, "doc", "id"))) == near(docs, items, slop)


def test_long_items_are_cut_into_stretches(spark, monkeypatch):
    monkeypatch.setattr(D, "STRETCH", 7)
    r = random.Random(8)
    item = " ".join(f"v{r.randrange(9)}" for _ in range(100))
    docs = [(i, " ".join(item.split()[i : i + 9 + i % 4])) for i in range(60)]
    assert result(spark, docs, [(1, item), (2, "v1")]) == brute(docs, [(1, item), (2, "v1")])


def test_stage_keeps_clean_rows(spark, odd):
    i = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven"), (2, "again")], "item_id long, text string")
    kept = D.decontaminate(odd, i)
    assert kept.columns == odd.columns
    assert [r["doc_id"] for r in kept.orderBy("doc_id").collect()] == [None, 1, 2, 3, 5, 6]


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    jvm, none = sc._jvm, sc._gateway.new_array(sc._jvm.double, 0)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_lists_of_common_words_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(D, "MOST_FOUND", 1)  # as if more was found than is broadcast
    docs = [(k, "the " * 400 + f"own{k}") for k in range(200)]
    docs[50] = (50, "the " * 200 + "rare odd the few " + "the " * 200)
    docs[51] = (51, "few the odd rare and the rest")
    index = D.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    items = spark.createDataFrame([(1, "rare odd few the")], "item_id long, text string")
    before = shuffled(spark)
    with D.session_conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        found = rows_of(D.proximity_matches(index, items), "id", "pos")
    assert found == [(1, 1), (1, 204)]
    assert shuffled(spark) - before < 5000  # of 80,000 places


def test_proximity_in_every_document_of_a_shard(spark):
    docs = [(k, f"{'x ' * (k % 131)}alpha {'y ' * (k % 50)}beta gamma") for k in range(4096)]
    index = D.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    items = spark.createDataFrame([(1, "gamma beta alpha")], "item_id long, text string")
    out = D.contamination(index, items, slop=50)
    near = {r["doc"] for r in out.filter("n_near = 1").collect()}
    assert near == {k for k, t in docs if abs(t.split().index("alpha") - t.split().index("gamma")) <= 50 and abs(t.split().index("alpha") - t.split().index("beta")) <= 50}


def test_no_task_indexes_more_than_its_share(spark, monkeypatch):
    with D.session_conf(spark, {"spark.sql.shuffle.partitions": "4"}):
        monkeypatch.setattr(D, "BLOCK_BITS", 6)
        few, many = (spark.range(a, b).select(F.col("id").alias("doc_id"), F.concat(F.lit("own"), "id").alias("text")).coalesce(1) for a, b in ((0, 70), (100, 330)))
        index = D.build_index(few.union(many))
        file = F.input_file_name().alias("file")
        held = index.filter("term IS NULL").select(file, "shard", "head.doc")
        per = sorted(n for _, n in rows_of(held.groupBy("file").count(), "file", "count"))
        assert sum(per) == 300 and len(per) == 4 and per[-1] <= 76  # a quarter, and one more for each task read
        assert max(n for _, n in rows_of(held.groupBy("shard").count(), "shard", "count")) == 64
        assert held.select("shard", "file").distinct().groupBy("shard").count().filter("count > 1").isEmpty()


def test_few_documents_have_few_shards(spark):
    with D.session_conf(spark, {"spark.sql.shuffle.partitions": "50"}):
        docs = spark.range(0, 500, 1, 2).select(F.col("id").alias("doc_id"), F.lit("all say this").alias("text"))
        assert D.build_index(docs).filter("term = 'this'").count() == 2
