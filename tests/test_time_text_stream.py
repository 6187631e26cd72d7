"""Time, scalars, search and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tests.conftest import rows_of
from weft.functions import predicates as P
from weft.functions import scalars as S
from weft.operators import aggregate as A
from weft.operators import scan as C
from weft.operators import temporal as T
from weft.operators import text as X
from weft.streaming import events as W

FACTS = "id int, valid_from timestamp, valid_to timestamp"


def day(n):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


def test_open_intervals(spark):
    f = spark.createDataFrame([(1, day(0), None), (2, None, day(5)), (3, day(2), day(3)), (4, day(8), day(9))], FACTS)
    assert rows_of(T.snapshot(f, "2020-01-06 00:00:00"), "id") == [(1,), (2,)]
    assert rows_of(T.changes(f, "2020-01-04 00:00:00", "2020-01-09 00:00:00", ["id"])) == [(2, "removed"), (3, "removed"), (4, "added")]
    assert f.filter(T.version_at("2020-01-04 00:00:00")).count() == 2  # the third ends there, half open


def test_overlaps_against_all_pairs(spark):
    import random

    r = random.Random(2)
    rows = [(i, i % 3, day(a := r.randrange(200)), day(a + r.randrange(90))) for i in range(80)]
    f = spark.createDataFrame(rows, "id int, k int, valid_from timestamp, valid_to timestamp")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    assert sorted((x["id"], x["b_id"]) for x in T.overlap_join(f, f, ["k"], 7).collect()) == want


def test_overlaps_of_open_intervals(spark):
    import random

    r = random.Random(5)
    rows = [(i, i % 3, day(r.randrange(200)) if r.random() < 0.8 else None, day(200 + r.randrange(90) - r.randrange(150)) if r.random() < 0.7 else None) for i in range(60)] + [(90, 7, None, None), (91, 7, None, None)]
    f = spark.createDataFrame(rows, "id int, k int, valid_from timestamp, valid_to timestamp")
    low, high = (lambda x: x or day(-1)), (lambda x: x or day(999))
    good = [x for x in rows if low(x[2]) <= high(x[3])]
    want = sorted((a[0], b[0]) for a in good for b in good if a[1] == b[1] and low(a[2]) <= high(b[3]) and low(b[2]) <= high(a[3]))
    assert sorted((x["id"], x["b_id"]) for x in T.overlap_join(f, f, ["k"], 30).collect()) == want
    facts = spark.createDataFrame([(1, "x", day(0), None), (1, "y", day(9), None)], "k int, v string, valid_from timestamp, valid_to timestamp")
    assert T.exclusive_conflicts(facts, ["k"], "v").count() == 1


def test_versions(spark):
    assert spark.range(1).select(T.next_version(F.lit("1.2.9")), T.next_version(F.lit("7"), "sequential")).first()[:] == ("1.2.10", "8")
    rows = spark.createDataFrame([("a", 1, "x", 0.5), ("a", 2, "y", 0.9), ("a", 3, "x", 0.5)], "k string, t int, v string, confidence double")
    assert rows_of(T.consensus(rows, ["k"], "v"), "v") == [("x",)]
    assert rows_of(T.resolved(rows, ["k"], [F.desc("confidence")]), "v") == [("y",)]


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(
        S.popcount(F.lit(255)), S.leading_zeros(F.lit(1).cast("long")), S.first_set(F.lit(8).cast("long")), S.position(F.array(F.lit(1), F.lit(3)), 3),
        S.spatial_key(F.lit(0.0), F.lit(250.0)), S.spatial_key(F.lit(None).cast("double"), F.lit(1.0)), S.compare_arrays(F.array(F.lit(1)), F.array(F.lit(2))),
        S.word_jaccard(F.lit("a b"), F.lit("B c")), S.word_jaccard(F.lit(""), F.lit("")), S.valid_name(F.lit("1x")), S.size_of(F.lit("é"), "string"),
        S.literal(F.lit('a"b'), "string"), S.decayed(F.lit(1.0), F.lit(False)), S.level_score(F.lit("Expert")), S.clean(F.lit(" a\tb ")),
        S.period_end(F.lit("2020-02-10").cast("timestamp"), "month"), S.to_micros(S.from_micros(F.lit(5))), S.euclidean(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))),
    ).first()
    assert got[:15] == (8, 63, 3, 1, "0_2", "unknown", -1, 1 / 3, 0.0, False, 2, '"a\\"b"', 0.8, 10, "ab")
    assert got[15] == dt.datetime(2020, 2, 29, 23, 59, 59, 999999) and got[16] == 5 and got[17] == 5.0
    z = F.struct(F.lit(3.0).alias("re"), F.lit(4.0).alias("im"))
    zz = one.select(z.alias("z")).select(S.magnitude("z"), S.complex_multiply("z", "z").alias("p")).first()
    assert zz[0] == 5.0 and (zz[1]["re"], zz[1]["im"]) == (-7.0, 24.0)
    m = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
    r = one.select(S.merge(m(a="1", b="2"), m(b="3")).alias("m"), S.maps_equal(m(a="1", b="2"), m(b="2", a="1")), (S.map_hash(m(a="1", b="2")) == S.map_hash(m(b="2", a="1")))).first()
    assert r[0] == {"a": "1", "b": "3"} and r[1] and r[2]


def test_predicates_on_missing_values(spark):
    rows = spark.createDataFrame([("a", {"k": "1"}, 2.0), ("b", {}, None)], "id string, properties map<string,string>, weight double")
    assert rows_of(rows.filter(P.negated(P.prop("k") == "1")), "id") == [("b",)]
    assert rows_of(rows.filter(P.weight_between(1, 3)), "id") == [("a",)]
    assert rows_of(rows.filter(P.filter_input(weight_min=1.0)), "id") == [("a",)]
    assert rows_of(rows.filter(P.wildcard("id", "?")), "id") == [("a",), ("b",)]
    assert rows.filter(P.has_all(F.array(F.lit("x")), F.array(F.lit("x"), F.lit("y")))).count() == 2


def test_changes(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert rows_of(C.upsert(rows, spark.createDataFrame([(2, None), (3, "c")], rows.schema))) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows_of(C.insert_new(rows, spark.createDataFrame([(2, "x"), (4, "d")], rows.schema))) == [(1, "a"), (2, "b"), (4, "d")]
    got = A.percentiles(spark.createDataFrame([("g", float(x)) for x in [5, 1, 5, 3, None or 2]], "k string, v double"), ["k"], "v").first()
    assert (got["n"], got["p50"], got["p99"]) == (5, 3.0, 5.0)


def test_entities_and_search(spark):
    rows = [(1, "Acme Corp", "org", 0.5, {"a": "1"}), (2, "acme corp", "org", 0.9, {"a": "2", "b": "3"}), (3, "Other", "org", 0.4, {}), (4, "acme corp", "person", 0.3, {})]
    e = spark.createDataFrame(rows, "id long, name string, type string, confidence double, attributes map<string,string>")
    got = {r["entity"]: (r["names"], r["confidence"], r["attributes"]) for r in X.merge_entities(e).collect()}
    assert got[1] == (["Acme Corp", "acme corp"], 0.9, {"a": "2", "b": "3"}) and set(got) == {1, 3, 4}
    assert rows_of(X.fuzzy_search(e, "name", "othr"), "id") == [(3,)]
    words = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(20) if j != i)) for i in range(4)] + [(9, "z")], "id long, t string")
    assert {(r["a"], r["b"]) for r in X.similar_texts(words, "id", "t", 0.85).collect()} == {(a, b) for a in range(4) for b in range(a + 1, 4)}
    alt = spark.createDataFrame([("x", 1.0, 0.25), ("x", 5.0, 0.75), ("y", 2.0, 1.0)], "k string, v double, p double")
    assert rows_of(X.expected_values(alt, ["k"], "v", "p"), "k", "expected") == [("x", 4.0), ("y", 2.0)]
    assert X.observe(alt, ["k"], "v", "p").count() == 2


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(i, day(0) + dt.timedelta(minutes=7 * i), i % 3, "error" if i % 5 == 0 else "view", float(i), "{}") for i in range(60)]
    df = spark.createDataFrame(rows, W.EVENTS)
    df.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    got = W.tumbling(W.stream(spark, str(tmp_path / "in")), "1 hour", ["event_type"], late=None)
    assert rows_of(W.run_to_memory(got, "tumbled", "complete", str(tmp_path / "c1"))) == rows_of(W.tumbling(df, "1 hour", ["event_type"]))
    state = W.running_state(W.stream(spark, str(tmp_path / "in"), files_per_trigger=9), "user_id", "long")
    last = W.run_to_memory(state, "running", "update", str(tmp_path / "c2")).groupBy("user_id").agg(F.max("n").alias("n"), F.max("total").alias("total"))
    assert rows_of(last) == rows_of(df.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


def test_change_feed(spark, tmp_path):
    for n, rows in enumerate([[(1, "a", "insert"), (2, "b", "insert")], [(1, None, "delete"), (2, "c", "update"), (3, "d", "insert")]]):
        spark.createDataFrame(rows, "id long, v string, op string").coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        feed = spark.readStream.schema("id long, v string, op string").parquet(str(tmp_path / "feed"))
        W.apply_changes(feed, str(tmp_path / "out"), "id", lambda old, new: C.apply_changes(old, new, "id"), str(tmp_path / "c")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / f"out/batch={n}")).count() == 2
    assert rows_of(spark.read.parquet(str(tmp_path / "out/batch=1")), "id", "v") == [(2, "c"), (3, "d")]


def test_written_tables_are_discarded(spark):
    from weft.plans import lineage

    t = lineage.table(spark.range(3), "kept")
    assert t.count() == 3 and lineage.small(t, 3) and not lineage.small(t, 2)
    lineage.discard(spark)
    assert not lineage._made


def test_nearest_in_blocks(spark, monkeypatch):
    from weft.operators import text

    r = __import__("random").Random(4)
    rows = spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(60)], "id long, v array<double>")
    want = sorted(map(tuple, text.nearest(rows, rows, "id", "v", 3).collect()))
    monkeypatch.setattr(text, "BLOCK", 25)
    assert sorted(map(tuple, text.nearest(rows, rows, "id", "v", 3).collect())) == want and len(want) == 180


def test_nearest_of_many_queries(spark):
    from weft.operators import text

    rows = spark.createDataFrame([(-1, [1.0, 0.0]), (-2, [0.0, 1.0])], "id long, v array<double>")
    queries = spark.range(10_050).select("id", F.array(F.lit(1.0), F.col("id") / 20_000).alias("v"))
    got = text.nearest(rows, queries, "id", "v", 1)
    assert got.count() == 10_050 and got.filter("neighbor <> -1").isEmpty()
