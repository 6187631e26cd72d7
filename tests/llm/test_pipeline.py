"""The pipeline on planted documents, held against plain versions of its stages."""

from __future__ import annotations

import random

import pytest

from tests.conftest import DATA, rows_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("planted"))
    r = random.Random(6)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(n))
    items = [(i, say(25)) for i in range(4)]
    clean = [(i, say(60)) for i in range(80)]
    toxic = [(100 + i, f"{say(20)} you idiot {say(5)} worthless moron {say(20)}") for i in range(8)]
    copies = [(200 + i, clean[i][1]) for i in range(5)]
    leaks = [(300 + i, f"{say(30)} {items[i % 4][1]} {say(30)}") for i in range(6)]
    keys = [(400 + i, f"{say(30)} token = {'0123456789abcdef' * 2}{i} {say(30)}") for i in range(4)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in clean + toxic + copies + leaks + keys] + [(500, None, None, None, None), (501, "", "en", "s0", 0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(i, 1, 1) for i, _ in toxic] + [(i, 1, 0) for i, _ in clean]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, planted):
    import corpus_pipeline

    docs = spark.read.parquet(f"{planted}/documents.parquet")
    columns, ids, left = docs.columns, [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = spark.createDataFrame(stage(spark, left, planted).collect(), DOCS)
        assert left.columns == columns
        ids.append({x for (x,) in rows_of(left, "doc_id")})
    every = {x for (x,) in rows_of(docs, "doc_id")}
    assert every - ids[0] == set(range(100, 108))
    assert ids[0] - ids[1] == set(range(200, 205)) | {501}  # both without words: the first one stays
    assert ids[1] - ids[2] == set(range(300, 306))
    assert ids[3] == ids[2]
    text = {r["doc_id"]: r for r in left.collect()}
    assert all("token" not in text[i]["text"] and "[SECRET]" in text[i]["text"] and text[i]["n_chars"] == len(text[i]["text"]) for i in range(400, 404))
    mix = corpus_pipeline.STAGES[-1][1](spark, left, planted).collect()
    size = lambda t: len((t or "").split())
    total = {}
    for m in mix:
        total[m["source"]] = total.get(m["source"], 0) + size(m["text"])
        assert size(m["text"]) == m["words"]
    assert all(abs(total[m["source"]] - m["target"]) <= 0.5 for m in mix)


def test_run(spark, planted):
    import corpus_pipeline

    assert rows_of(corpus_pipeline.run(spark, planted), "doc_id", "repeat", "words") == rows_of(corpus_pipeline.run(spark, planted), "doc_id", "repeat", "words")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-dedup", "decontamination", "secrets", "mixing"]


def test_oracles(spark):
    import os

    import duckdb

    from tests.conftest import plain
    from weft.llm.queries import ORACLE_SQL, QUERIES

    if not os.path.isdir(DATA):
        pytest.skip("the tables are not here")
    assert len(QUERIES) == 10
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    for name, sql in ORACLE_SQL.items():
        df, found = QUERIES[name](spark, DATA), con.execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df, *sorted(columns)) == sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall()), key=repr)


def test_odd_and_empty_documents(spark, planted, odd, none):
    import corpus_pipeline
    from pyspark.sql import functions as F

    clash = {c: F.lit("x") for c in ("toxic", "fp", "root", "row", "term", "pos", "mark", "spans", "size", "target", "taken", "repeat", "id", "source_size", "words", "host", "_y", "_doc", "stays")}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, planted).count() == 0
        out = stage(spark, odd.withColumns(clash), planted)
        assert out.count() >= 1 and set(odd.columns) <= set(out.columns), name
        if name in ("toxicity", "secrets"):
            assert rows_of(out.select(*odd.columns)) == rows_of(odd)
        if name != "mixing":
            assert out.columns == [*odd.columns, *clash]


def test_empty_labels_and_benchmark(spark, planted, tmp_path):
    import corpus_pipeline

    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{planted}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["decontamination"](spark, docs, str(tmp_path)).count() == docs.count()
    assert stages["toxicity"](spark, docs, str(tmp_path)).filter("doc_id between 100 and 107").count() == 0  # the lexicon alone
