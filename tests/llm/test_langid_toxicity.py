from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import DATA, rows_of
from weft.llm import langid, toxicity
from weft.llm.queries import op3_langid, op5_toxicity


def test_languages_of_held_out_rows(spark, sample):
    got = {r["doc_id"]: r for r in op3_langid(spark, DATA).collect()}
    rows = sample.collect()
    assert len(got) == len(rows)
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if got[r["doc_id"]]["held_out"]]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.9 * len(held)
    assert all(0 <= g["score"] <= 1 for g in got.values())


def test_languages_of_odd_rows(spark, odd, none):
    train = spark.createDataFrame([("the house and the tree", "en"), ("das haus und der baum", "de"), ("x", None), (None, "en"), ("12 34", "fr")], "text string, lang string")
    m = langid.fit(train)
    got = rows_of(langid.identify(odd.withColumn("lang_pred", F.lit("x")), m), "doc_id", "lang_pred")
    assert [x for i, x in got if i in (1, 2, 3)] == ["und"] * 3 and len(got) == odd.count()
    assert m.predict(["the tree", "das haus", "hausen", "²³ 12", "日本"])[0][0] == "en"
    assert [x for x, _ in m.predict(["das haus", "und der", "²³ 12"])] == ["de", "de", "und"]
    assert langid.fit(none.select("text", "lang")).predict(["a b"]) == [("und", 0.0)]
    assert langid.identify(none, m).count() == 0


class Held(langid.Model):
    """A model in a dictionary."""

    def find(self, kind, keys):
        there = np.array([(kind, k) in self.held for k in keys], bool)
        return there, np.array([self.held[kind, k] for k in keys if (kind, k) in self.held]).reshape(-1, len(self.languages))


def test_backoff_takes_the_longest_known():
    m = Held(["a", "b"])
    m.held = {("word", "known"): [-1.0, -2.0], ("gram", "abcde"): [-3.0, -4.0], ("gram", "z"): [-5.0, -6.0]}
    logs, sure = m.of_words(["known", "xabcdez", "qzq", "qqq"])
    assert logs.tolist() == [[-1, -2], [-3, -4], [-5, -6], [0, 0]] and sure.tolist() == [True, True, True, False]
    long = "known xabcdez " * 400_000  # more than one chunk alone
    assert m.predict([long, "", "qzq"])[1] == ("und", 0.0) and m.predict([long])[0][0] == "a"


def plain_model(rows):
    """All counts in dictionaries."""
    langs = sorted({lang for t, lang in rows if t is not None and lang is not None})
    counts = {k: Counter() for k in range(6)}
    for t, lang in rows:
        if t is not None and lang is not None:
            for w in langid.words(t):
                counts[0][lang, w] += 1
                for k in range(1, 6):
                    for g in langid.grams(w, k):
                        counts[k][lang, g] += 1
    m = Held(langs)
    m.held = {}
    for k, c in counts.items():
        names = {g for _, g in c}
        sums = [sum(n for (a, _), n in c.items() if a == lang) + 0.5 * len(names) for lang in langs]
        m.held |= {("gram" if k else "word", g): [math.log((c[lang, g] + 0.5) / s) for lang, s in zip(langs, sums, strict=True)] for g in names}
    return m


def test_predictions_against_plain_counts(spark, sample, odd, monkeypatch):
    monkeypatch.setattr(langid, "A_SHARD", 20_000)  # several files
    train = sample.filter(~langid.held_out())
    m = langid.fit(train)
    assert m.bits >= 2
    plain = plain_model([(r["text"], r["lang"]) for r in train.collect()])
    docs = sample.unionByName(odd).collect()
    got = langid.identify(spark.createDataFrame(docs, sample.schema), m).collect()
    want = plain.predict([r["text"] or "" for r in docs])
    for r, (name, p) in zip(got, want, strict=True):
        assert r["lang_pred"] == name and abs(r["score"] - p) < 1e-3


def test_toxicity_of_held_out_rows(spark):
    sf = DATA.replace("0.001", "0.1")
    got = {r["doc_id"]: r for r in op5_toxicity(spark, sf).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    known = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]}
    both = sum(y and got[i]["predicted"] for i, y in known.items())
    assert both >= 0.9 * sum(known.values()) and sum(got[i]["predicted"] for i in known) - both <= 0.01 * len(known)


def test_scores_against_plain_sums(spark, sample, odd):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    m = toxicity.fit(sample, labels)
    docs = sample.unionByName(odd).collect()
    weights = dict(zip(m.voters, m.weights, strict=True))
    for r, text in zip(toxicity.score(spark.createDataFrame(docs, sample.schema), m).collect(), [r["text"] or "" for r in docs], strict=True):
        found = re.findall(r"[^\W\d_]+", text.lower())
        each = [{x for x in (w, f"{w[:4]}-" if len(w) > 4 else "", f"{w[:5]}-" if len(w) > 5 else "", f"{w[:6]}-" if len(w) > 6 else "") if x in weights} for w in sorted(set(found))]
        fired = set().union(*each)
        insults, mined = sum(any(x in toxicity.LEXICON for x in e) for e in each), sum(bool(e) and not any(x in toxicity.LEXICON for x in e) for e in each)
        fired |= {g for g, n in zip(toxicity.GROUPS, (insults, insults - 1, mined, mined - 1, mined - 2), strict=True) if n > 0 and g in weights}
        fired |= {f"<{p}>" for p in toxicity.patterns(text, found)}
        assert abs(r["score"] - 1 / (1 + math.exp(-(m.bias + sum(weights[v] for v in fired))))) < 1e-9


def test_toxic_words_are_learned(spark):
    clean = "these are some plain words about weather and trees".split()
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, " ".join([clean[i % 9], clean[i % 7], *(["grumpfel", f"snark{i % 7}"] if bad else []), clean[i % 4]])))
        labels.append((i, int(bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (1, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    m = toxicity.fit(docs.withColumn("toxic", F.lit("clash")).withColumn("_y", F.lit(0)), lab)
    assert m.score("a grumpfel snark2 here") > 0.5 > 0.2 > m.score("plain words about trees") and m.score("") < 0.3
    assert m.score("you idiot, you worthless moron") > 0.3
    assert [r["doc_id"] for r in toxicity.keep_clean(docs, m).orderBy("doc_id").collect()] == [i for i in range(600) if i % 5]


def test_toxicity_without_labels(spark, odd, none):
    m = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert m.score("what an idiot and loser") > 0.5 > m.score("a plain text")
    assert toxicity.score(odd, m).count() == odd.count() and toxicity.score(none, m).count() == 0
    assert toxicity.keep_clean(odd, m).columns == odd.columns


def test_label_model_finds_the_noisy_voter():
    rng = np.random.default_rng(3)
    y = rng.random(3000) < 0.3
    good, same = np.where(rng.random(3000) < 0.9, y, ~y), rng.random(3000) < 0.5
    votes = np.stack([good, np.where(rng.random(3000) < 0.85, y, ~y), same, same, same], 1).astype(np.float32)
    noisy = np.where(rng.random(3000) < 0.9, y, ~y).astype(float)
    q, share = toxicity.label_model(votes, noisy, 0.3)
    assert ((q > 0.5) == y).mean() > 0.93 and share[2] < 0.5 < share[0]
