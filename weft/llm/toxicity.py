"""Toxicity by weak supervision: voters, a generative model of them, and a linear classifier on its posterior labels.

Voters are a short lexicon of insults, each word and how many, patterns (shouting, runs of exclamation marks, masked
words, one word again and again, being addressed), and words and beginnings of words that go with the label in a bounded
sample of labelled rows, again each and how many.
Each fires on a text or not. The label model has for each voter the chance to fire on toxic and on other texts, learned by
expectation and maximization with the sample's labels as one more, noisy, voter; voters that are correlated beyond what the
label explains share their weight. A logistic regression on what fires is trained on the posterior labels and scores texts.

Learned from at most SAMPLE_TOXIC and SAMPLE_OTHER labelled rows, chosen by the hash of their ids, and not from other
folds. Labels that are null are left out; of labels that contradict each other the toxic one counts. Null and empty texts
fire nothing and get the score of such. Repeated rows give repeated results; an empty table gives an empty one; without
labels the lexicon alone decides. Columns of other names are kept by keep_clean() and left out by score().
"""

from __future__ import annotations

import re
import string
from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, map_batches, small_batches, strings, table

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
SAMPLE_TOXIC, SAMPLE_OTHER = 6_000, 12_000
#: Texts, log likelihood ratio (doubled) and ratio of the classes' shares that a mined voter has at least.
LEAST_TEXTS, LEAST_RATIO, LEAST_LIFT = 4, 30.0, 5.0
#: Voters that are compared with all others at a time.
STRIP = 256
BEGINNINGS = (4, 5, 6)
#: Chance that a label of the sample is right, at first; correlation from which voters share weight.
LABEL_RIGHT, CORRELATED = 0.95, 0.3
#: Weights that the lexicon's words and their group start with, and keep where the sample does not show them.
WORD_WEIGHT, GROUP_WEIGHT = 3.0, 3.0
REMEMBERED = 200_000

# Insults in some languages.
LEXICON = (
    "asshole bastard bitch clown disgusting dumb fool idiot jerk loser moron pathetic scum stupid trash ugly worthless "
    "arschloch dummkopf idiotisch abschaum versager widerlich connard imbécile salaud débile minable pourriture "
    "estúpido idiota imbécil basura patético asqueroso inútil"
).split()
#: Voters that fire with one, two or three different words of the lexicon or of those mined.
GROUPS = ("<lexicon>", "<lexicon 2>", "<mined>", "<mined 2>", "<mined 3>")
PATTERNS = ("shouting", "exclaiming", "masked", "repeating", "addressing")

_LETTERS = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"\b[^\W\d_]+[*#@$]{2,}[^\W\d_]")
_ADDRESSED = re.compile(r"\b(?:you|you're|du bist|tu es|vous êtes|eres)\s+(?:an?|ein|eine|un|une|una)\b", re.IGNORECASE)
_UPPER, _LOWER = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
AGAIN = 10  # times that one word follows itself


def repeats(words: list[str]) -> bool:
    """Whether a word stands AGAIN times in a row."""
    ends = map(eq, words, words[AGAIN - 1 :])  # the first and the last of a row are equal: few places are left to look at
    return any(same and words[i : i + AGAIN] == [words[i]] * AGAIN for i, same in enumerate(ends))


def patterns(text: str, words: list[str]) -> list[str]:
    """Names of the patterns that fire on a text and its lower-cased words."""
    raw = text.encode()
    upper, lower = (len(raw) - len(raw.translate(None, letters)) for letters in (_UPPER, _LOWER))
    fired = []
    if upper >= 20 and upper >= 0.6 * (upper + lower):
        fired.append("shouting")
    if "!!" in text:
        fired.append("exclaiming")
    if ("**" in text or "##" in text or "@@" in text or "$$" in text) and _MASKED.search(text):
        fired.append("masked")
    if repeats(words):
        fired.append("repeating")
    if _ADDRESSED.search(text):
        fired.append("addressing")
    return fired


def marks(word: str) -> list[str]:
    """What mined voters may be: the word, and its beginnings."""
    return [word, *(f"{word[:k]}-" for k in BEGINNINGS if len(word) > k)]


@dataclass
class Model:
    voters: list[str]
    weights: np.ndarray
    bias: float
    at: dict[str, int] = field(init=False)
    seen: dict[str, tuple[int, ...]] = field(init=False)

    def __post_init__(self):
        self.at, self.seen = {v: i for i, v in enumerate(self.voters)}, {}

    def fired(self, text: str) -> list[int]:
        """Numbers of the voters that fire."""
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        out: set[int] = set()
        insults = mined = 0
        words = _LETTERS.findall(text.lower())
        for w in set(words):
            found = self.seen.get(w)
            if found is None:
                found = self.seen[w] = tuple(self.at[m] for m in marks(w) if m in self.at)
            if found:
                out.update(found)
                insults += found[0] < len(LEXICON)
                mined += found[0] >= len(LEXICON)
        out.update(self.at[g] for g, n in zip(GROUPS, (insults, insults - 1, mined, mined - 1, mined - 2), strict=True) if n > 0 and g in self.at)
        out.update(self.at[f"<{p}>"] for p in patterns(text, words))
        return sorted(out)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-(self.bias + self.weights[self.fired(text)].sum()))))


def label_model(votes: np.ndarray, labels: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Posterior chance of toxic, and the voters' shares of weight. labels: 1, 0, and the noisy voter's right from the start."""
    q = np.where(labels == 1, LABEL_RIGHT, 1 - LABEL_RIGHT).astype(float)
    share, right = np.ones(votes.shape[1]), np.array([LABEL_RIGHT, LABEL_RIGHT])  # of toxic, of other labels
    for r in range(rounds):
        both = np.stack([1 - q, q])
        fire = ((both.astype(np.float32) @ votes).astype(float) + 0.1) / (both.sum(1, keepdims=True) + 0.2)  # by class: chance to fire
        right = np.array([(q @ labels + 5) / (q.sum() + 5.5), ((1 - q) @ (1 - labels) + 5) / ((1 - q).sum() + 5.5)])
        if r == 5 or r == 15:  # correlation of what the label doesn't explain
            rest = votes - (both.T @ fire).astype(np.float32)
            rest[:, ~votes.any(0)] = 0  # a voter that never fires goes with none
            rest /= np.sqrt((rest**2).mean(0)) + 1e-9
            for i in range(0, len(share), STRIP):
                c = np.abs(rest.T @ rest[:, i : i + STRIP]) / len(votes)
                share[i : i + STRIP] = 1 / np.where(c >= CORRELATED, c, 0).sum(0).clip(1)
        on, off = np.log(fire[1] / fire[0]) * share, np.log((1 - fire[1]) / (1 - fire[0])) * share
        odds = np.log(prior / (1 - prior)) + (votes @ (on - off).astype(np.float32)).astype(float) + off.sum()
        odds += np.where(labels == 1, np.log(right[0] / (1 - right[1])), np.log((1 - right[0]) / right[1]))
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return q, share


def regression(x: np.ndarray, q: np.ndarray, weight: np.ndarray, start: np.ndarray, rounds: int = 400, penalty: float = 0.0002) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam over all rows, drawn towards the weights that it starts from."""
    first, second = (np.zeros(x.shape[1] + 1) for _ in range(2))
    w = np.append(start, -3.0)
    for t in range(1, rounds + 1):
        d = weight * (1 / (1 + np.exp(-((x @ w[:-1].astype(np.float32)).astype(float) + w[-1]))) - q)
        g = np.append((d.astype(np.float32) @ x).astype(float) / weight.sum() + penalty * (w[:-1] - start), d.sum() / weight.sum())
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def sample_labels(labels: DataFrame, key: str, label: str) -> tuple[DataFrame, float]:
    """(key, _y) of at most so many toxic and other rows, and the share of toxic ones among all."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("_y"))
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    parts = 1_000_000
    share = lambda y, most: min(parts, parts * most // max(1, sizes.get(y, 0)))
    few = known.filter(F.pmod(F.xxhash64(F.col(key), F.lit(31)), F.lit(parts)) < F.when(F.col("_y") == 1, share(1, SAMPLE_TOXIC)).otherwise(share(0, SAMPLE_OTHER)))
    return few, sizes.get(1, 0) / max(1, sum(sizes.values()))


def mine(rows: DataFrame, toxic: int, other: int) -> list[str]:
    """Marks of words that go with toxic rows of (text, _y): all that the thresholds let through, of a bounded sample's words."""
    small_batches(rows.sparkSession)

    def counts(batches):
        held: tuple[Counter, Counter] = Counter(), Counter()

        def sent():
            names = list(held[0].keys() | held[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([held[1][n] for n in names], pa.int64()), pa.array([held[0][n] for n in names], pa.int64())], ["mark", "toxic", "other"])
            for h in held:
                h.clear()
            return out

        for b in batches:
            for t, y in zip(strings(b.column(0)), b.column(1).to_pylist(), strict=True):
                held[y].update({m for w in set(_LETTERS.findall(t.lower())) for m in marks(w)})
            if len(held[0]) + len(held[1]) > 500_000:
                yield sent()
        if held[0] or held[1]:
            yield sent()

    sums = rows.select("text", "_y").mapInArrow(counts, "mark string, toxic long, other long").groupBy("mark").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    a, b, share = F.col("a"), F.col("b"), toxic / (toxic + other)
    ratio = 2 * (a * F.log(a / (a + b) / share) + F.when(b > 0, b * F.log(b / (a + b) / (1 - share))).otherwise(0))
    lift = (a / toxic) / ((b + 0.5) / other)
    best = sums.filter(a >= LEAST_TEXTS).withColumn("ratio", ratio).filter((F.col("ratio") >= LEAST_RATIO) & (lift >= LEAST_LIFT))
    return [r["mark"] for r in best.orderBy(F.desc("ratio"), "mark").collect()]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model from the labelled rows of docs."""
    few, prior = sample_labels(labels.select(key, label), key, label)
    # The sample is bounded, so it is broadcast, and the documents stay where they are.
    rows = table(docs.select(F.col(key).alias("_k"), F.col(text).alias("text")).join(F.broadcast(few), F.col("_k") == F.col(key)).select("text", "_y"), "labelled")
    sizes = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    fixed = [*LEXICON, *(f"<{p}>" for p in PATTERNS)]
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    plain = Model(fixed, np.array([4.0] * len(LEXICON) + [0.0] * len(PATTERNS)), -4.0)
    if toxic < LEAST_TEXTS or other < LEAST_TEXTS:
        return plain
    voters = [*fixed, *GROUPS, *(m for m in mine(rows, toxic, other) if m not in LEXICON)]
    probe = Model(voters, np.zeros(len(voters)), 0.0)
    found = map_batches(rows, lambda b: {"y": b.column(1), "fired": [probe.fired(t) for t in strings(b.column(0))]}, "y int, fired array<int>").collect()
    votes, y = np.zeros((len(found), len(voters)), np.float32), np.array([r["y"] for r in found], float)
    for i, r in enumerate(found):
        votes[i, r["fired"]] = 1
    weight = np.where(y == 1, prior / (toxic / len(y)), (1 - prior) / (other / len(y)))  # as in the whole
    q, share = label_model(votes, y, toxic / len(y))
    start = np.array([WORD_WEIGHT if v in LEXICON else GROUP_WEIGHT if v == GROUPS[0] else 0.0 for v in voters])
    weights, bias = regression(votes * np.sqrt(share).astype(np.float32), q, weight, start)
    return Model(voters, weights * np.sqrt(share), bias)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size

    def f(batch: pa.RecordBatch) -> dict:
        p = [held.value.score(t) for t in strings(batch.column(1))]
        return {key: batch.column(0), "score": p, "predicted": [int(x >= THRESHOLD) for x in p]}

    return map_batches(docs.select(key, text), f, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without those that the model takes for toxic."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([held.value.score(t) < THRESHOLD for t in strings(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id") -> Column:
    return fold(key, FOLDS) == HELD_OUT
