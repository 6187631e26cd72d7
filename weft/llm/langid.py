"""Language identification: words by their log frequency in each language, unseen words by ever shorter character n-grams.

A word is a run of letters, lower-cased. A known word adds, for each language, the log of its frequency there. One that is
unknown is marked at both ends and cut into n-grams of 5 characters; where none of them is known, of 4, and so on to 1, and
adds the mean of the known ones' logs. The language with the highest sum wins; the score is its share of the sums'
exponentials, the sums divided by the root of the number of words, so that long texts are not all certain.

Learned from a sample of rows with text and language: at most SAMPLE of each language, chosen by the hash of the text. All
their words and n-grams are kept: words are counted once, n-grams from the different words, and the logs lie as arrays,
sorted by hash, in the shared folder, in shards of a bounded number; workers map them. Only the names of the languages,
and sums over them, come to the driver.

Texts that are null or have no letter are `und`, score 0. Rows without a language are not learned from. Ties go to the
first language by name. Repeated rows give repeated results; where nothing can be learned all is `und`. Extra columns
are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Writer, firsts, reader_of
from .common import fold, map_batches, shared_path, small_batches, strings, table

SAMPLE = 4_000
LONGEST = 5
#: Added to each count; what an unseen n-gram of one character counts is left out.
ADD = 0.5
UNKNOWN = "und"
#: Characters of the texts that are taken apart at a time; words and n-grams wanted in a shard of the model.
CHUNK, A_SHARD = 2_000_000, 4_000_000
#: Spark's and xxhash's seed for the same hash.
SEED = 42
FOLDS, HELD_OUT = 4, 2

_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    found = _LETTERS.findall(text.lower())
    return found if "".join(found).isalpha() or not found else [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def grams(word: str, n: int) -> list[str]:
    marked = f" {word} " if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, a bounded number of characters at a time (a longer text comes alone)."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > CHUNK:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


@dataclass
class Model:
    """Logs of words' and n-grams' frequencies: a row of a matrix each, a column a language, in files by the hash's first bits."""

    languages: list[str]
    folder: str = ""
    bits: int = 0

    def find(self, kind: str, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which of keys (of kind word or gram) are known, and these ones' logs."""
        h = np.fromiter((xxhash.xxh64_intdigest(k.encode(), SEED) for k in keys), np.uint64, len(keys))
        shard = (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        there, logs = np.zeros(len(h), bool), np.zeros((len(h), len(self.languages)), np.float32)
        order, first = firsts(shard)
        for part in np.split(order, first[1:]) if len(first) else []:
            s = int(shard[part[0]])
            file = reader_of(self.folder, f"logs-{s}")
            own = file.arrays(s) if file else {}
            if own and len(own[kind]):
                at = np.minimum(np.searchsorted(own[kind], h[part]), len(own[kind]) - 1)
                hit = own[kind][at] == h[part]
                there[part] = hit
                logs[part[hit]] = own[f"{kind}_logs"].view(np.float32).reshape(-1, len(self.languages))[at[hit]]
        return there, logs[there]

    def of_words(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each distinct word's logs (0 where not even a character is known), and whether something is known of it."""
        out = np.zeros((len(found), len(self.languages)))
        sure, logs = self.find("word", found)
        out[sure] = logs
        left = np.flatnonzero(~sure)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            cut = [grams(found[i], n) for i in left.tolist()]
            place = {g: i for i, g in enumerate(dict.fromkeys(g for c in cut for g in c))}
            there, logs = self.find("gram", list(place))
            row = np.cumsum(there) - 1
            sizes = np.fromiter(map(len, cut), np.int64, len(cut))
            at = np.fromiter((place[g] for c in cut for g in c), np.int64, int(sizes.sum()))
            word, rows = np.repeat(left, sizes)[there[at]], row[at[there[at]]]
            if len(rows):
                starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                counts = np.diff(np.concatenate((starts, [len(word)])))
                out[word[starts]] = np.add.reduceat(logs[rows].astype(float), starts, axis=0) / counts[:, None]
                sure[word[starts]] = True
                left = left[~sure[left]]
        return out, sure

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        out: list[tuple[str, float]] = []
        for part in chunks(texts):
            found = [words(t) for t in part]
            place = {w: i for i, w in enumerate(dict.fromkeys(w for f in found for w in f))}
            logs, sure = self.of_words(list(place))
            for f in found:
                if not f:
                    out.append((UNKNOWN, 0.0))
                    continue
                rows = np.fromiter(map(place.__getitem__, f), np.int64, len(f))
                total, n = logs[rows].sum(0), int(sure[rows].sum())
                best = int(np.argmax(total))
                share = np.exp((total - total[best]) / np.sqrt(max(1, n)))
                out.append((self.languages[best], float(1 / share.sum())))
        return out


def counted_words(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of the words of rows (lang, text), as a written table."""
    small_batches(rows.sparkSession)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: Counter = Counter()
            for language, t in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                held.update((language, w) for w in words(t))
            if held:
                langs, names = zip(*held, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(names, pa.string()), pa.array(held.values(), pa.int64())], ["lang", "gram", "n"])

    return table(rows.mapInArrow(counts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "words")


def cut_words(found: DataFrame) -> DataFrame:
    """(kind, lang, gram, n) of the n-grams of counted words; kind is their length."""
    piece = lambda of, n: F.when(F.length(of) >= n, F.transform(F.sequence(F.lit(1), F.length(of) - n + 1), lambda i: F.substring(of, i, F.lit(n))))
    marked = F.concat(F.lit(" "), F.col("gram"), F.lit(" "))
    every = F.array(*[F.struct(F.lit(n).alias("kind"), piece(marked if n > 1 else F.col("gram"), n).alias("grams")) for n in range(1, LONGEST + 1)])
    cut = found.select("lang", "n", F.inline(every)).select("kind", "lang", F.explode("grams").alias("gram"), "n")
    return cut.groupBy("kind", "lang", "gram").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    parts = 1_000_000
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    names = sorted(sizes)
    if not names:
        return Model([])
    share = rows.sparkSession.createDataFrame([(k, parts * sample // n) for k, n in sizes.items()], "_l string, _share long")
    few = rows.join(F.broadcast(share), F.col("lang") == F.col("_l")).filter(F.pmod(F.xxhash64("text", F.lit(29)), F.lit(parts)) < F.col("_share"))
    found = counted_words(few.select("lang", "text"))
    every = table(found.select(F.lit(0).alias("kind"), "lang", "gram", "n").unionByName(cut_words(found)), "grams")
    sums = every.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()  # some rows a language
    kinds = {r["kind"]: r["n"] for r in every.select("kind", "gram").distinct().groupBy("kind").agg(F.count("*").alias("n")).collect()}
    n = sum(kinds.values())
    model = Model(names, shared_path(rows.sparkSession, "languages"), max(0, int(np.ceil(np.log2(max(1, n) / A_SHARD)))))
    whole = np.zeros((LONGEST + 1, len(names)))
    for r in sums:
        whole[r["kind"], names.index(r["lang"])] = r["n"]
    write(every, model, np.log(whole + ADD * np.array([[kinds.get(k, 0)] for k in range(LONGEST + 1)]) + 1e-300))
    return model


def write(every: DataFrame, model: Model, sums: np.ndarray) -> None:
    """The arrays of the model, a file a shard, from (kind, lang, gram, n) and the logs of all kinds' smoothed sums."""
    at, folder = {name: i for i, name in enumerate(model.languages)}, model.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            shards, kinds, keys, counts = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1, 3, 4))
            langs = np.array([at[x] for b in held for x in b.column(2).to_pylist()], np.int64)
            shard = int(shards[0])
            file, arrays = Writer(folder, f"logs-{shard}"), {}
            for kind, mine in (("word", kinds == 0), ("gram", kinds > 0)):
                h = keys[mine].view(np.uint64)
                order, first = firsts(h)
                x = np.zeros((len(first), len(at)))
                row = np.empty(len(h), np.int64)
                row[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
                x[row, langs[mine]] = counts[mine]
                logs = np.log(x + ADD) - sums[kinds[mine][order[first]]]
                arrays |= {kind: h[order[first]], f"{kind}_logs": logs.astype(np.float32).ravel().view(np.uint32)}
            file.add(shard, **arrays)
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64())], ["shard"])

    h = F.xxhash64("gram")
    shard = F.shiftrightunsigned(h, 64 - model.bits).cast("int") if model.bits else F.lit(0)
    dealt = every.select(shard.cast("long").alias("shard"), "kind", "lang", h.alias("h"), "n").repartitionById(1 << model.bits, F.col("shard").cast("int"))
    dealt.mapInArrow(run, "shard long").collect()  # a row a shard


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score)."""

    def f(batch: pa.RecordBatch) -> dict:
        found = model.predict(strings(batch.column(1)))
        return {key: batch.column(0), "lang_pred": [x for x, _ in found], "score": [p for _, p in found]}

    return map_batches(docs.select(key, text), f, f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")


def held_out(key: str = "doc_id") -> F.Column:
    return fold(key, FOLDS) == HELD_OUT
