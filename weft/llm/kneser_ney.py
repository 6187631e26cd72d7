"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, kept as sorted hash arrays that workers map into memory.

Tokens are words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, then one end a text; before a text stand as many
begins as a context is long. Words are known by 64-bit hashes, n-grams by hashes of theirs. One pass counts tokens, another
the n-grams of the highest order; each task sums what it has seen before it sends it, packed by shard, and each shard's
task adds up what it gets, writes its arrays, sorted by hash, and tells the next lower order of the different n-grams that
it has and of their contexts. Numbers of shards grow with the corpus, so a task's memory does not: beyond 2^FAN_BITS shards
blobs are gathered by their first bits and dealt again, so that they stay large, and beyond 2^FILE_BITS several shards, one
after the other, write one file with their offsets at its end. An n-gram goes to the shard of its context; where all words
of the context are hot (more than a shard's quarter of all tokens) it goes by itself. Counts are as wide as they must be.

Order n, contexts u, words w: p_n(w|u) = max(c(u,w) - D(c), 0) / c(u) + g(u) p_(n-1)(w|u without its first word), with c
the number of times for the highest order, and below it the number of different words before; p_1 is given g / (V + 1) for
every word, with V distinct tokens, end included. Three discounts for each order come from the counts of counts. After a
context that was never seen the lower order holds. Scoring is a narrow pass: workers map the files that they need, a
bounded number at a time, and read from stores that cannot be mapped into memory, never into a local folder.

Null texts count as empty and null ids as the id of empty text. Repeated rows each count. An empty table gives an empty
result; without training rows every token has probability 1 / (V + 1). Extra columns are left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Writer, firsts, narrow, reader_of
from .common import LOWER, fold, shared_path, small_batches, utf8

HELD_OUT = 10
ADD, ORDER = 0.1, 2
#: Tokens that a task gathers before it sends their sums, and tokens wanted in a shard of each kind.
FLUSH, TOKENS_A_SHARD, GRAMS_A_SHARD = 3_000_000, 8_000_000, 2_000_000
#: Shards that one task deals to, and files of a kind, at most, as numbers of bits.
FAN_BITS, FILE_BITS = 12, 16
#: Words that a worker remembers the hash of.
REMEMBERED = 300_000
END, BEGIN = xxhash.xxh64_intdigest(b""), xxhash.xxh64_intdigest(b"\n")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and the number of tokens of each text."""
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    words: list[bytes] = []
    counts = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = t.translate(LOWER).split()
        words += own
        words.append(b"")  # no word is empty: its hash is END
        counts[i] = len(own) + 1
    return np.array(list(map(_hashes.__getitem__, words)), np.uint64), counts


def previous(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    u = np.empty_like(h)
    u[1:] = h[:-1]
    u[np.cumsum(counts) - counts] = BEGIN
    return u


def grams(h: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """The words of the n-gram that ends at each token, a column each."""
    columns = [h]
    for _ in range(order - 1):
        columns.insert(0, previous(columns[0], counts))
    return columns


def mixed(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two."""
    x = (u * np.uint64(0x9E3779B97F4A7C15)) ^ (w + np.uint64(0xD1B54A32D192ED03))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def named(columns: list[np.ndarray]) -> np.ndarray:
    """An n-gram's hash: a word's own, else that of its context and its last word."""
    x = columns[0]
    for c in columns[1:]:
        x = mixed(x, c)
    return x


def summed(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, and the values of each added up."""
    if not len(keys):
        return keys, [v.astype(np.int64) for v in values]
    order, first = firsts(keys)
    return keys[order[first]], [np.add.reduceat(v[order].astype(np.int64), first) for v in values]


def summed_grams(columns: list[np.ndarray], c: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct n-grams by their hash: hashes in order, columns, sums."""
    key = named(columns)
    order, first = firsts(key)
    at = order[first]
    return key[at], [x[at] for x in columns], np.add.reduceat(c[order].astype(np.int64), first) if len(key) else c.astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    arrays = tuple(map(narrow, arrays))
    kinds = np.array([len(arrays), len(arrays[0]), *(a.dtype.itemsize for a in arrays)], np.int64)
    return zstandard.compress(kinds.tobytes() + b"".join(a.tobytes() for a in arrays), 1)


def unpack(blobs: list[bytes]) -> list[np.ndarray]:
    """The arrays of all blobs, one after another."""
    parts: list[list[np.ndarray]] = []
    for b in blobs:
        raw = zstandard.decompress(b)
        k, n = np.frombuffer(raw, np.int64, 2).tolist()
        at, own = 16 + 8 * k, []
        for width in np.frombuffer(raw, np.int64, k, 16).tolist():
            own.append(np.frombuffer(raw, f"u{width}", n, at))
            at += n * width
        parts.append(own)
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def shard_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def route(columns: list[np.ndarray], key: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """What deals an n-gram to its shard: its context, or itself where all words of that are hot."""
    context = named(columns[:-1])
    if not len(hot):
        return context
    return np.where(np.logical_and.reduce([np.isin(c, hot) for c in columns[:-1]]), key, context)


def sliced(by: np.ndarray, bits: int, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(shard, blob) of arrays, dealt by the first bits of `by`."""
    order = np.argsort(by, kind="stable")
    arrays = tuple(a[order] for a in arrays)
    shard = shard_of(by[order], bits)
    edges = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(shard) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(shard[a]), pack(*(x[a:b] for x in arrays))


@dataclass
class Model:
    """Where the arrays lie, and the sums over them."""

    folder: str
    order: int
    token_bits: int
    gram_bits: int = 0
    n: int = 0
    v: int = 0
    pairs: int = 0
    hot: list[int] = field(default_factory=list)
    #: By order, from 1; and what the discounts of order 1 leave for unseen words.
    discounts: list[tuple[float, ...]] = field(default_factory=list)
    left: float = 1.0
    file_bits: int = FILE_BITS

    def arrays(self, kind: str, shard: int, bits: int) -> dict[str, np.ndarray]:
        reader = reader_of(self.folder, f"{kind}-{shard >> max(0, bits - self.file_bits)}")
        return reader.arrays(shard) if reader else {}


def discounts(counts: list[int]) -> tuple[float, ...]:
    """Three discounts from how many n-grams are seen once, twice, three and four times."""
    n = counts
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))


def frequencies(c: np.ndarray) -> list[int]:
    """How many there are, and how many of one, two, three and four."""
    return [len(c), *np.bincount(np.minimum(c, 5).astype(np.int64), minlength=6)[1:5].tolist()]


# Passes over texts and shards. Rows on the way are (shard, blob, counts); counts only go to the last shard.

_WAY = "shard long, blob binary, counts array<long>"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    s, blobs, counts = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(blobs, pa.binary()), pa.array(counts, pa.list_(pa.int64()))], ["shard", "blob", "counts"])


def _sends(df: DataFrame, make: Callable) -> DataFrame:
    """make(hashes, texts' token counts) gives (shard, blob) for about FLUSH tokens of a partition at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(tokens(utf8(b.column(0))))
                n += len(held[-1][0])
            if n >= FLUSH:
                yield from (_rows([(s, x, None)]) for s, x in make(*map(np.concatenate, zip(*held, strict=True))))
                held, n = [], 0
        if held:
            yield from (_rows([(s, x, None)]) for s, x in make(*map(np.concatenate, zip(*held, strict=True))))

    return df.mapInArrow(run, _WAY)


def _gathered(sent: DataFrame, bits: int, again: Callable) -> DataFrame:
    """Where there are very many shards, blobs were dealt by their first FAN_BITS bits; again(blobs) deals them by all bits."""
    if bits <= FAN_BITS:
        return sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now = [], 0, None
        for b in batches:
            for s, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (s != now or size >= FLUSH):
                    yield from (_rows([(k, x, None)]) for k, x in again(held))
                    held, size = [], 0
                now, size = s, size + len(blob) // 4
                held.append(blob)
        if held:
            yield from (_rows([(k, x, None)]) for k, x in again(held))

    return sent.repartitionById(1 << FAN_BITS, F.col("shard").cast("int")).sortWithinPartitions("shard").mapInArrow(run, _WAY)


def _by_shard(sent: DataFrame, bits: int, kinds: int, work: Callable, schema: str) -> DataFrame:
    """work(shard, blobs, counts, file) for every shard, in order, of `kinds` kinds with so many bits each, and one of counts.

    file(kind, shard) gives the writer of a shard's file; a file is closed when the task comes to the next one.
    """
    step = max(0, bits - FILE_BITS)
    groups = (kinds << (bits - step)) + 1
    group = F.least(F.shiftright("shard", step), F.lit(groups - 1)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[tuple, Writer] = {}

        def file(folder: str, kind: str, shard: int) -> Writer:
            key = folder, f"{kind}-{shard >> step}"
            if key not in files:
                while files:
                    files.popitem()[1].close()
                files[key] = Writer(*key)
            return files[key]

        now, blobs, counts = None, [], []
        for b in batches:
            for s, blob, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if s != now and now is not None:
                    yield from work(now, blobs, counts, file)
                    blobs, counts = [], []
                now = s
                blobs += [] if blob is None else [blob]
                counts += [] if c is None else [c]
        if now is not None:
            yield from work(now, blobs, counts, file)
        while files:
            files.popitem()[1].close()

    return sent.repartitionById(groups, group).sortWithinPartitions("shard").mapInArrow(run, schema)


def count(texts: DataFrame, order: int = ORDER) -> Model:
    """The model of the column of texts, of order 2 or more, its arrays written to the shared folder."""
    spark = texts.sparkSession
    small_batches(spark)
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    bits = lambda n, each: int(np.ceil(np.log2(max(1.0, n / each))))
    m = Model(shared_path(spark, "ngrams"), order, bits(size / 6, TOKENS_A_SHARD), file_bits=FILE_BITS)
    folder, a = m.folder, m.token_bits

    # Tokens.

    def token_sums(h: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
        h = np.concatenate([h, np.full(len(counts), BEGIN, np.uint64)])
        key, (c,) = summed(h, [np.ones(len(h), np.uint32)])
        return sliced(key, min(a, FAN_BITS), key, c)

    def token_again(blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
        key, c = unpack(blobs)
        key, (c,) = summed(key, [c])
        return sliced(key, a, key, c)

    kept = "n long, v long, words array<long>, counts array<long>"

    def add_tokens(s: int, blobs: list, counts: list, file: Callable) -> Iterator[pa.RecordBatch]:
        key, c = unpack(blobs)
        key, (c,) = summed(key, [c])
        file(folder, "token", s).add(s, token=key, count=c)
        top = np.argsort(c)[-64:]
        begin = int(c[key == BEGIN].sum())
        row = [int(c.sum()) - begin], [len(c) - bool(begin)], [key[top].view(np.int64).tolist()], [c[top].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], ["n", "v", "words", "counts"])

    found = _by_shard(_gathered(_sends(texts, token_sums), a, token_again), a, 1, add_tokens, kept).collect()  # a row a shard
    m.n, m.v = sum(r["n"] for r in found), sum(r["v"] for r in found)
    m.gram_bits = p = bits(m.n, GRAMS_A_SHARD)
    m.hot = [w & (2**64 - 1) for r in found for w, c in zip(r["words"], r["counts"], strict=True) if c * 4 << p >= m.n] if p else []
    hot = np.array(m.hot, np.uint64)

    # N-grams of the highest order from the texts, of lower ones from what was said of them.

    def gram_sums(h: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
        key, columns, c = summed_grams(grams(h, counts, order), np.ones(len(h), np.uint32))
        return sliced(route(columns, key, hot), min(p, FAN_BITS), *columns, c)

    def gram_again(blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
        *columns, c = unpack(blobs)
        key, columns, c = summed_grams(columns, c)
        return sliced(route(columns, key, hot), p, *columns, c)

    def told(columns: list[np.ndarray], c: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """What n-grams say to the next lower order: of their contexts, and of themselves without the first word."""
        context = named(columns[:-1])
        key, sums = summed(context, [c == 1, c == 2, c > 2, c])
        if len(columns) == 2:
            after, (one,) = summed(columns[1], [np.ones(len(c), np.uint32)])
            both, sums = summed(np.concatenate([key, after]), [np.concatenate([x, np.zeros(len(after), np.int64)]) for x in sums] + [np.concatenate([np.zeros(len(key), np.int64), one])])
            yield from sliced(both, a, both, *sums)
            return
        yield from ((s + (1 << p), x) for s, x in sliced(key, p, key, *sums))
        key, rest, one = summed_grams(columns[1:], np.ones(len(c), np.uint32))
        yield from sliced(route(rest, key, hot), p, *rest, one)

    def add_grams(k: int) -> Callable:
        last = 1 << (p + (k < order))  # the shard of counts
        after = 1 << a if k == 2 else 1 << (p + 1)

        def work(s: int, blobs: list, counts: list, file: Callable) -> Iterator[pa.RecordBatch]:
            if s >= last:
                yield from (_rows([(after, None, c)]) for c in counts)
            elif s >> p:
                key, *sums = unpack(blobs)
                key, (once, twice, more, total) = summed(key, sums)
                file(folder, f"context{k}", s - (1 << p)).add(s - (1 << p), token=key, once=once, twice=twice, more=more, total=total)
            else:
                *columns, c = unpack(blobs)
                key, columns, c = summed_grams(columns, c)
                file(folder, f"gram{k}", s).add(s, token=key, count=c)
                yield from (_rows([(t, x, None)]) for t, x in told(columns, c))
                yield _rows([(after, None, [k, *frequencies(c)])])

        return work

    kept = "level long, counts array<long>"

    def add_words(s: int, blobs: list, counts: list, file: Callable) -> Iterator[pa.RecordBatch]:
        rows = [(c[0], c[1:]) for c in counts]
        if s < 1 << a:
            key, *sums = unpack(blobs)
            key, (once, twice, more, total, after) = summed(key, sums)
            file(folder, "word", s).add(s, token=key, once=once, twice=twice, more=more, total=total, after=after)
            rows = [(1, frequencies(after[after > 0]))]
        levels: dict[int, np.ndarray] = {}
        for k, c in rows:
            levels[k] = levels.get(k, 0) + np.array(c, np.int64)
        if levels:
            yield pa.RecordBatch.from_arrays([pa.array(list(levels), pa.int64()), pa.array([x.tolist() for x in levels.values()], pa.list_(pa.int64()))], ["level", "counts"])

    sent = _gathered(_sends(texts, gram_sums), p, gram_again)
    for k in range(order, 1, -1):
        sent = _by_shard(sent, p, 1 + (k < order), add_grams(k), _WAY)
    totals: dict[int, np.ndarray] = {}
    for r in _by_shard(sent, a, 1, add_words, kept).collect():  # a row a shard
        totals[r["level"]] = totals.get(r["level"], 0) + np.array(r["counts"], np.int64)
    m.discounts = [discounts(totals[k][1:].tolist()) if k in totals else (0.5, 1.0, 1.5) for k in range(1, order + 1)]
    if 2 in totals:
        m.pairs = int(totals[2][0])
        types, once, twice = totals[1][:3].tolist()
        m.left = float(np.dot(m.discounts[0], (once, twice, types - once - twice))) / m.pairs
    return m


STATS = ("once", "twice", "more", "total")


def looked_up(m: Model, kind: str, bits: int, by: np.ndarray, key: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
    """Numbers of distinct keys, dealt to shards by `by`; 0 for those that are not there."""
    out = [np.zeros(len(key), np.int64) for _ in names]
    shard = shard_of(by, bits)
    order, first = firsts(shard)
    for part in np.split(order, first[1:]) if len(first) else []:
        own = m.arrays(kind, int(shard[part[0]]), bits)
        if own and len(own["token"]):
            at = np.minimum(np.searchsorted(own["token"], key[part]), len(own["token"]) - 1)
            there = own["token"][at] == key[part]
            for x, name in zip(out, names, strict=True):
                x[part] = np.where(there, own[name][at], 0)
    return out


def each_once(key: np.ndarray, f: Callable) -> list[np.ndarray]:
    """f of where each distinct key is first, for all keys."""
    order, first = firsts(key)
    back = np.empty(len(key), np.int64)
    back[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    return [x[back] for x in f(order[first])]


def logs(m: Model, h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's training count, and log10 of its base and its Kneser-Ney probability."""
    hot = np.array(m.hot, np.uint64)
    columns = grams(h, counts, m.order)
    words = np.unique(np.append(h, np.uint64(BEGIN)))
    (count,) = looked_up(m, "token", m.token_bits, words, words, ("count",))
    stats = looked_up(m, "word", m.token_bits, words, words, (*STATS, "after"))
    at = np.searchsorted(words, h)
    c, k = np.where(h == BEGIN, 0, count[at]), stats[4][at]
    base = np.log10((c + ADD) / (m.n + ADD * (m.v + 1)))
    off = lambda d, x: np.take((0.0, *d), np.minimum(x, 3))
    d = m.discounts[0]
    p = m.left / (m.v + 1) + (k - off(d, k)) / max(1, m.pairs)
    for k in range(2, m.order + 1):
        own, d = columns[m.order - k :], m.discounts[k - 1]
        key = named(own)
        (times,) = each_once(key, lambda i: looked_up(m, f"gram{k}", m.gram_bits, route([x[i] for x in own], key[i], hot), key[i], ("count",)))  # noqa: B023
        if k == 2:
            of = np.searchsorted(words, own[0])
            once, twice, more, total = (x[of] for x in stats[:4])
        else:
            context = named(own[:-1])
            once, twice, more, total = each_once(context, lambda i: looked_up(m, f"context{k - 1}", m.gram_bits, context[i], context[i], STATS))  # noqa: B023
        whole = np.maximum(total, 1)
        p = np.where(total > 0, (times - off(d, times)) / whole + (d[0] * once + d[1] * twice + d[2] * more) / whole * p, p)
    return c, base, np.log10(p)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) of every text."""
    small_batches(docs.sparkSession)
    kept, kind = pickle.dumps(model), docs.schema[key].dataType.simpleString()
    names = [key, "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(kept)
        for b in batches:
            if b.num_rows:
                h, counts = tokens(utf8(b.column(1)))
                starts = np.cumsum(counts) - counts
                c, base, kn = logs(m, h, counts)
                sums = [np.add.reduceat(x, starts) for x in ((c > 0).astype(np.int64), base, kn)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), *map(pa.array, sums)], names)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, n_known long, base_score double, score double")


def held_out(key: str = "doc_id", of: int = HELD_OUT) -> F.Column:
    return fold(key, of) == 0


def score_held_out(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Scores of all texts by the model of those that are not held out, with held_out and train_tokens."""
    model = count(docs.filter(~held_out(key)).select(text), order)
    scored = score(docs, model, key, text)
    return scored.withColumns({"held_out": held_out(key), "train_tokens": F.lit(model.n).cast("long")})
